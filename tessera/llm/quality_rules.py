"""Quality rules: base rules on word statistics, then robust multivariate outliers.

For each language and source (small ones: language, or all rows) the minimum covariance determinant estimate of location and scatter is found by concentration
steps over all rows that pass the base rules: distances are binned on a fixed logarithmic grid, a grouped sum per bin of
counts and moments combines before its one shuffle, and the bins nearest the centre up to a share CORE of the rows give the
next estimate. Steps go on from two starts at once until no determinant falls any more; the start that ends with the least
determinant gives the estimate. The starts are the coordinates' medians and quartile ranges, from a fixed grid as well, and
mean and covariance of all rows. Nothing is sampled and no group meets in one task. A transformed statistic vector is rejected
when its squared Mahalanobis distance passes CUT.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import texthash
from .scratch import Scratch

#: A text of fewer words fails, as does one with more than this share of repeated words.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Share of rows in the core, rows that a group needs for its own estimate.
CORE, LEAST_ROWS = 0.6, 200
#: Concentration steps at most, and the fall of a logarithm of a determinant that calls for another step.
STEPS, SETTLED = 10, 0.01
#: Name of the group of all rows; the others are JSON arrays.
EVERYTHING = "*"
#: Squared distance from which a vector is rejected; the chi-square quantile at one in 10**9 for six coordinates is 53.
CUT = 60.0
#: Words by which each ratio is drawn towards its prior, so that short texts aren't outliers by chance.
PRIOR_WORDS = 60

#: name, least standard deviation.
COORDINATES = (("x_length", 0.05), ("x_symbols", 0.15), ("x_lines", 0.06), ("x_repeats", 0.05), ("x_upper", 0.15), ("x_marks", 0.15))
NAMES = [n for n, _ in COORDINATES]
FLOOR = np.array([s for _, s in COORDINATES])
GRID = 64  # bins per unit

_SYMBOL, _UPPER, _MARK, _POINT = (np.zeros(256, np.uint8) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[0x41:0x5B] = 1
_MARK[list(b"!?.,;:\"'()[]{}=_/\\~^@+-0123456789")] = 1
_POINT[:] = 1
_POINT[0x80:0xC0] = 0
_IN_WORD = (_POINT.astype(bool) & ~texthash.SEPARATOR).astype(np.uint8)

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, n_lines long"
_COUNTED = [c.split()[0] for c in STATS.split(", ")]


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts in STATS of each text."""
    raw, off = texthash.buffers(column)
    n = len(off) - 1
    out = {}

    def counted(table):
        total = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]]

    for name, table in (("word_chars", _IN_WORD), ("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_marks", _MARK)):
        out[name] = counted(table)
    words, at = texthash.word_hashes(raw, off, fold=False)
    out["n_words"] = np.diff(at)
    repeated, dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        k = max(len(words) - 2, 0)
        windows = texthash.mix(words[:k] * texthash.COEFFICIENT[0] + words[1 : k + 1] * texthash.COEFFICIENT[1] + words[2 : k + 2] * texthash.COEFFICIENT[2])
    data = raw.tobytes()
    for i in range(n):
        lo, hi = at[i], at[i + 1]
        if hi - lo > 3:
            own = windows[lo : hi - 2]
            ordered = np.sort(own)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                again = np.isin(own, twice)
                covered = np.zeros(hi - lo, bool)
                for s in range(3):
                    covered[s : s + len(own)] |= again
                repeated[i] = covered.sum()
        full = [x for x in data[off[i] : off[i + 1]].split(b"\n") if x.strip(b" \t\v\f\r")]
        lines[i], dup[i] = len(full), len(full) - len(set(full))
    return out | {"n_repeat_words": repeated, "n_dup_lines": dup, "n_lines": lines}


def _with_statistics(text_at: int, text_stays: bool):
    def run(batches):
        for batch in batches:
            for part in texthash.parts(batch, text_at):
                found = statistics(part.column(text_at))
                kept = [k for k in range(part.num_columns) if text_stays or k != text_at]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *(pa.array(found[c].astype(np.int64)) for c in _COUNTED)], names=[*(part.schema.names[k] for k in kept), *_COUNTED])

    return run


def transformed() -> dict[str, Column]:
    """Log-odds-like transforms of shrunken ratios, one per coordinate."""
    c = F.col
    prior, words, chars = F.lit(float(PRIOR_WORDS)), c("n_words"), c("word_chars")
    root = lambda x: F.sqrt(x)  # noqa: E731  variance of a count's root hardly depends on the count
    return {
        "x_length": F.log((chars + 5.0 * prior) / (words + prior)),
        "x_symbols": F.log1p(100.0 * c("n_symbols") / (chars + 5.0 * prior)),
        "x_lines": root(c("n_dup_lines") / (c("n_lines") + 3.0)),
        "x_repeats": c("n_repeat_words") / (words + prior),
        "x_upper": F.log1p(100.0 * c("n_upper") / (chars + 5.0 * prior)),
        "x_marks": F.log1p(100.0 * c("n_marks") / (chars + 5.0 * prior)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _pairs():
    return [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]


def _distance(mu: str = "mu", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance; inverse is the upper triangle, off-diagonal entries doubled."""
    diff = [F.col(n) - F.col(mu)[i] for i, n in enumerate(NAMES)]
    return sum((diff[i] * diff[j] * F.col(inverse)[k] for k, (i, j) in enumerate(_pairs())), F.lit(0.0))


def estimate(n: float, sums: np.ndarray, products: np.ndarray, trimmed: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """(centre, inverse scatter, logarithm of the scatter's determinant) from moments. The scatter of a core is scaled to the whole under
    normality; each coordinate has a least deviation."""
    mu = sums / n
    d = len(mu)
    cov = np.zeros((d, d))
    for k, (i, j) in enumerate(_pairs()):
        cov[i, j] = cov[j, i] = products[k] / n - mu[i] * mu[j]
    scale = 1.9 if trimmed else 1.0  # CORE / P(chi2[d + 2] <= the CORE quantile of chi2[d]), for d = 6
    cov = scale * (cov + cov.T) / 2 + np.diag(FLOOR**2)
    return mu, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _flat(inverse: np.ndarray) -> list[float]:
    return [float(inverse[i, j]) * (1 if i == j else 2) for i, j in _pairs()]


_PARAMS = "g string, start int, mu array<double>, inverse array<double>, det double"


def _from_moments(trimmed: bool):
    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                mu, inverse, det = estimate(r.n, np.array(r.sums), np.array(r.products), trimmed)
                rows.append((r.g, r.start, [float(x) for x in mu], _flat(inverse), det))
            yield pd.DataFrame(rows, columns=["g", "start", "mu", "inverse", "det"])

    return run


class RobustOutliers:
    """Minimum covariance determinant per group of rows (g, coordinates)."""

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.spark, self.scratch = spark, scratch

    def _medians(self, rows: DataFrame) -> DataFrame:
        """Medians and quartile ranges, read off cumulative counts over a fixed grid."""
        long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(n) * GRID).alias("b")) for i, n in enumerate(NAMES)])).alias("x")).groupBy("g", "x.i", "x.b").agg(F.count("*").alias("n"))
        w = Window.partitionBy("g", "i")
        cumulative = long.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))

        def quantile(q):
            return F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("b"))) / GRID

        each = cumulative.groupBy("g", "i").agg(quantile(0.5).alias("m"), (quantile(0.75) - quantile(0.25)).alias("iqr"))
        per = each.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "m", "iqr"))).alias("x"))
        floor = F.array(*[F.lit(float(s)) for s in FLOOR])
        diagonal = F.transform("x", lambda x, i: 1.0 / (F.pow(x["iqr"] / 1.349, 2) + F.pow(F.get(floor, i), 2)))
        flat = F.array(*[F.get(diagonal, F.lit(i)) if i == j else F.lit(0.0) for i, j in _pairs()])
        return per.select("g", F.lit(0).alias("start"), F.transform("x", lambda x: x["m"]).alias("mu"), flat.alias("inverse"), F.lit(float("inf")).alias("det"))

    def _moments(self):
        return [F.count("*").alias("n"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)], *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, j in _pairs()]]

    def _estimates(self, summed: DataFrame, trimmed: bool) -> DataFrame:
        sums = [F.sum(f"s{i}") for i in range(len(NAMES))]
        products = [F.sum(f"p{i}_{j}") for i, j in _pairs()]
        per = summed.groupBy("g", "start").agg(F.sum("n").alias("n"), F.array(*sums).alias("sums"), F.array(*products).alias("products"))
        return per.mapInPandas(_from_moments(trimmed), _PARAMS)

    def _start(self, rows: DataFrame) -> DataFrame:
        whole = self._estimates(rows.groupBy("g").agg(*self._moments()).withColumn("start", F.lit(1)), False)
        return self._medians(rows).unionByName(whole.withColumn("det", F.lit(float("inf"))))

    def _step(self, rows: DataFrame, params: DataFrame) -> DataFrame:
        """One concentration step of every group and start. Whole bins are taken until they hold CORE of the rows."""
        binned = rows.join(params, "g").withColumn("b", F.floor(F.log2(_distance() + 1e-9) * GRID)).groupBy("g", "start", "b").agg(*self._moments())
        w = Window.partitionBy("g", "start")
        core = binned.withColumn("before", F.sum("n").over(w.orderBy("b")) - F.col("n")).withColumn("all", F.sum("n").over(w)).where(F.col("before") < CORE * F.col("all"))
        return self._estimates(core, True)

    def fit(self, rows: DataFrame) -> DataFrame:
        """(g, mu, inverse, det): of each group's starts the end with the least determinant, the first one where they are equal."""
        params = self.scratch.keep(self._start(rows), "params")
        for _ in range(STEPS):
            after = self.scratch.keep(self._step(rows, params), "params")
            both = after.select("g", "start", F.col("det").alias("new")).join(params.select("g", "start", "det"), ["g", "start"])
            params = after
            if both.where(F.col("new") < F.col("det") - SETTLED).isEmpty():
                break
        ended = F.struct(F.col("det"), F.col("start"), "mu", "inverse")
        return self.scratch.keep(params.groupBy("g").agg(F.min(ended).alias("x")).select("g", "x.mu", "x.inverse", "x.det"), "params")


def _judged(spark: SparkSession, docs: DataFrame, keys: tuple[str, ...], text_stays: bool) -> DataFrame:
    """key0.. for keys, the counts, base_failed, distance and kept, a row per row of docs. With text_stays the last of keys is the text."""
    scratch = Scratch(spark, "quality")
    named = [F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]
    group = [F.to_json(F.array(F.col("lang").cast("string"))).alias("gl"), F.to_json(F.array(F.col("lang").cast("string"), F.col("source").cast("string"))).alias("gs")]
    ins = docs.select(*group, *named) if text_stays else docs.select(*group, *named, F.col("text").cast("string").alias("text"))
    schema = ", ".join(["gl string", "gs string", *(f"key{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)), STATS])
    stats = ins.mapInArrow(_with_statistics(len(keys) + (1 if text_stays else 2), text_stays), schema).withColumn("base_failed", base_failed())
    stats = scratch.keep(stats.withColumns(transformed()), "statistics")
    passed = stats.where("not base_failed").select("gl", "gs", *NAMES)
    counts = scratch.keep(passed.groupBy("gl", "gs").agg(F.count("*").alias("n")), "counts")
    per_lang = counts.groupBy("gl").agg(F.sum("n").alias("nl"))
    by = F.when(F.col("n") >= LEAST_ROWS, F.col("gs")).when(F.col("nl") >= LEAST_ROWS, F.col("gl")).otherwise(F.lit(EVERYTHING))
    groups = scratch.keep(counts.join(per_lang, "gl").select("gl", "gs", by.alias("g")), "groups")
    # Each estimate that is asked for is made of all rows of its level, also those that have an estimate of their own.
    asked = groups.select("g").distinct()
    levels = groups.select("gs", F.explode(F.array("gs", "gl", F.lit(EVERYTHING))).alias("g")).join(asked, "g", "left_semi")
    params = RobustOutliers(spark, scratch).fit(passed.join(scratch.keep(levels, "levels"), "gs"))
    named = scratch.keep(groups.select("gs", "g").join(params, "g").select("gs", "mu", "inverse", "det"), "named")  # a table, so that its true size decides the join
    found = stats.join(named, "gs", "left").withColumn("distance", F.when(F.col("mu").isNotNull(), _distance()))
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(False)))


def judge(spark: SparkSession, docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, the counts, base_failed, kept and distance for every row of docs.

    A null text is an empty one and fails the base rules. Null languages or sources form groups of their own. A group of
    fewer than LEAST_ROWS rows that pass the base rules is judged by the estimate over all rows of its language, and if these are too
    few by that over all rows, however few; so every row that passes has a distance. Repeated rows count each. Texts are taken whole, however long.
    Other columns are ignored. An empty table gives an empty one."""
    judged = _judged(spark, docs, keys, False)
    return judged.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], *_COUNTED, "base_failed", "kept", "distance")


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, each judged by its own text, language and source; all columns stay.

    Nulls, small groups, repeated rows and empty tables are as in judge(); rows go through one table and no shuffle."""
    names = [c for c in docs.columns if c != "text"] + ["text"]
    judged = _judged(spark, docs, tuple(names), True).where("kept")
    return judged.select(*[F.col(f"key{names.index(c)}").alias(c) for c in docs.columns])
