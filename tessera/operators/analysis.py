"""Analyses of a task's rules over predicates: reachability, abstract costs, occurrences. What grows with the objects is a table."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ir import Action, Const, Task
from ..scratch import Tables


def occurrences(action: Action) -> Counter:
    """Variable -> number of the precondition atoms that hold it."""
    return Counter(v for x in action.atoms for v in x.variables)


def defining_rules(task: Task) -> Counter:
    """Predicate -> number of the actions that add it."""
    return Counter(p for a in task.actions for p in {e.pred for e in a.adds})


def reachable_predicates(task: Task) -> set[int]:
    """Predicates that can ever hold, by rules over predicates alone."""
    holds, grown = {p for p, _ in task.init}, True
    while grown:
        grown = False
        for a in task.actions:
            if all(x.pred in holds for x in a.atoms):
                more = {e.pred for e in a.adds} - holds
                grown |= bool(more)
                holds |= more
    return holds


def abstract_costs(task: Task, combine=sum) -> tuple[dict[int, int], dict[int, int]]:
    """(inside, outside) per predicate: the least cost of any fact of it from the first state, and the least that is spent besides it on a way to
    the goal, both by relaxation of the rules over predicates until nothing falls. Predicates that can't be reached are left out."""
    inside = {p: 0 for p, _ in task.init}
    rules = [(e.pred, sorted({x.pred for x in a.atoms}), a.cost) for a in task.actions for e in a.adds]
    fell = True
    while fell:
        fell = False
        for head, body, cost in rules:
            if all(p in inside for p in body):
                total = cost + combine([inside[p] for p in body] or [0])
                if total < inside.get(head, total + 1):
                    inside[head], fell = total, True
    outside, fell = {g.pred: 0 for g in task.goal if not g.negated and g.pred in inside}, True
    while fell:
        fell = False
        for head, body, cost in rules:
            if head in outside and all(p in inside for p in body):
                for k, p in enumerate(body):
                    total = outside[head] + cost + combine([inside[q] for q in body[:k] + body[k + 1 :]] or [0])
                    if total < outside.get(p, total + 1):
                        outside[p], fell = total, True
    return inside, outside


def argument_candidates(spark: SparkSession, task: Task, facts: DataFrame | None = None) -> DataFrame:
    """(p, place, o): objects that may ever stand at a place of a predicate; place is null for a predicate without arguments that may hold.

    A place gets what a rule's variable may be, which is what all places of it in the rule's body may be. facts (p, a): the first
    state as a table; without it the task's."""
    tables = Tables(spark, "candidates")
    start = facts if facts is not None else spark.createDataFrame([(p, list(a)) for p, a in task.init] or [], "p int, a array<int>")
    found = tables.append("found", start.select("p", F.posexplode_outer("a").alias("place", "o")).distinct(), 0)
    turn = 0
    while True:
        turn += 1
        parts = []
        there = {r.p for r in found.select("p").distinct().collect()}  # predicates: as many as the task names
        for a in task.actions:
            if not all(x.pred in there for x in a.atoms):
                continue
            of: dict = {}
            for x in a.atoms:
                for k, t in enumerate(x.args):
                    of.setdefault(t, []).append((x.pred, k))
            for e in a.adds:
                for k, t in enumerate(e.args):
                    if isinstance(t, Const):
                        parts.append(spark.range(1).select(F.lit(e.pred).alias("p"), F.lit(k).alias("place"), F.lit(t.value).alias("o")))
                    elif t in of:
                        own = [found.where((F.col("p") == p) & (F.col("place") == j)).select("o") for p, j in of[t]]
                        parts.append(reduce(lambda x, y: x.join(y, "o", "left_semi"), own).select(F.lit(e.pred).alias("p"), F.lit(k).alias("place"), "o"))
                if not e.args:
                    parts.append(spark.range(1).select(F.lit(e.pred).alias("p"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("o")))
        if not parts:
            return found
        new = reduce(DataFrame.unionByName, parts).distinct().alias("n")
        old = found.alias("f")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("p", "place", "o")]
        new = tables.keep(new.join(old, same, "left_anti"))
        if new.isEmpty():
            return found
        found = tables.append("found", new, turn)


def pruned_by_degree(edges: DataFrame, least: int, tables: Tables) -> DataFrame:
    """edges (a, b) without the nodes that have fewer than `least` neighbours, again and again until all that are left have: nodes of a clique of
    k need k - 1."""
    edges = tables.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    n = edges.count()
    while True:
        degree = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        kept = edges.join(degree.select("a"), "a", "left_semi").join(degree.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
        kept = tables.keep(kept)
        left = kept.count()
        if left == n:
            return kept
        edges, n = kept, left
