"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v). Link what hangs on u to the least node of its neighbourhood."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """edges (u, v) of any orderable type, u <> v -> (node, component), component being the least node reached.

    Every step is a grouped minimum, which combines before the shuffle, and an equi-join; nothing is collected.
    Nodes without an edge don't appear. Empty in, empty out."""
    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most):
        after_large = _star(_both(now), True)
        step = scratch.keep(_star(after_large, False), "edges")
        mark = step.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("v", "u") % 1000003), F.lit(0))).first()
        scratch.drop(now)
        now = step
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
