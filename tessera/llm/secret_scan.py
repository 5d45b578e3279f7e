"""Secret scans over an incremental blob ledger, in DataFrame expressions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger lists the (blob, kind, rule version) triples
scanned so far. A run scans each blob once for the rules that it has not been scanned for, whatever the number of paths and
versions that hold it, adds to the findings and the ledger, and joins findings back to every path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The patterns and least lengths of the base kinds, in order.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # never matches an empty string and looks at nothing outside its match
    group: int  # the group whose length counts
    least: int
    version: int = 1
    base: bool = True


#: HEX is scanned in runs of the least length: shorter runs fail whatever follows, and runs are maximal either way.
RULES = (Rule("assign", ASSIGN, 2, 8), Rule("access", ACCESS, 0, 16), Rule("hex", r"[0-9a-f]{32,}", 0, 32))

LEDGER = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, version int, start long, end long"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _code(kind: Column | str, version: Column | int) -> Column:
    return F.concat_ws("@", kind if isinstance(kind, Column) else F.lit(kind), F.lit(version).cast("string") if isinstance(version, int) else version.cast("string"))


class SecretScan:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules

    def unseen(self, versions: DataFrame, ledger: DataFrame | None, text_col: str = "text") -> DataFrame:
        """(blob, text, todo): each distinct blob with the rules still to be run on it. todo is empty nowhere."""
        blobs = versions.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        wanted = F.array(*[_code(r.kind, r.version) for r in self.rules])
        if ledger is None:
            return blobs.withColumn("todo", wanted)
        seen = ledger.groupBy("blob").agg(F.collect_set(_code(F.col("kind"), F.col("version"))).alias("seen"))
        return blobs.join(seen, "blob", "left").select("blob", "text", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)

    def scan(self, unseen: DataFrame) -> DataFrame:
        """Findings of the rules to do: leftmost non-overlapping matches per kind, those that are too short dropped."""
        raw = []
        for k, r in enumerate(self.rules):
            matches = F.when(F.array_contains("todo", _code(r.kind, r.version)) & F.col("text").rlike(r.pattern), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)))
            gaps = F.transform(F.split("text", r.pattern, -1), F.length)
            raw.append(F.when(matches.isNotNull(), F.struct(F.lit(k).alias("k"), matches.alias("found"), gaps.alias("gaps"))))
        per_kind = unseen.select("blob", F.explode(F.array_compact(F.array(*raw))).alias("x"))
        # One row per match; offsets are running sums within a blob's kind, wherever its matches are many.
        each = per_kind.select("blob", F.col("x.k").alias("k"), F.posexplode(F.arrays_zip(F.col("x.found").alias("match"), F.slice("x.gaps", F.lit(1), F.size("x.found")).alias("gap"))).alias("at", "m"))
        each = each.select("blob", "k", "at", F.col("m.match").alias("match"), F.col("m.gap").cast("long").alias("gap"), F.length("m.match").cast("long").alias("n")).repartition("blob")
        so_far = Window.partitionBy("blob", "k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        each = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(so_far))
        long_enough = F.lit(False)
        for k, r in enumerate(self.rules):
            long_enough = F.when(F.col("k") == k, F.length(F.regexp_extract("match", r.pattern, r.group)) >= r.least).otherwise(long_enough)
        kind = F.element_at(F.array(*[F.lit(r.kind) for r in self.rules]), F.col("k") + 1)
        version = F.element_at(F.array(*[F.lit(r.version) for r in self.rules]), F.col("k") + 1)
        return each.where(long_enough).select("blob", kind.alias("kind"), version.alias("version"), (F.col("end") - F.col("n")).alias("start"), "end")

    def run(self, versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """(findings, ledger) with this run's added. versions: any columns beside the text; a null text is the empty blob.

        Repeated texts are one blob; texts are scanned whole, however long. An empty table adds nothing."""
        todo = self.unseen(versions, ledger, text_col)
        found = self.scan(todo)
        scanned = todo.select("blob", F.explode("todo").alias("code")).select("blob", F.substring_index("code", "@", 1).alias("kind"), F.substring_index("code", "@", -1).cast("int").alias("version"))
        return (found if findings is None else findings.unionByName(found)), (scanned if ledger is None else ledger.unionByName(scanned))

    def by_blob(self, findings: DataFrame) -> DataFrame:
        """(blob, n_<kind>..., spans, base_spans): spans as kind:start:end by start, then kind in the order of the rules; base_spans has those of the
        base rules only. Findings that are listed twice, as after a run that broke off, count once."""
        current = F.lit(False)
        place = F.lit(len(self.rules))
        for k, r in enumerate(self.rules):
            current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
            place = F.when(F.col("kind") == r.kind, F.lit(k)).otherwise(place)
        grouped = findings.where(current).groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", place.alias("place"), "end", "kind"))).alias("x"))
        joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
        of = lambda kinds: F.filter("x", lambda s: s["kind"].isin(kinds))
        return grouped.select("blob", *[F.size(of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in self.rules], joined(F.col("x")).alias("spans"), joined(of([r.kind for r in self.rules if r.base])).alias("base_spans"))

    def by_path(self, versions: DataFrame, findings: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """keys, n_<kind>..., spans and base_spans for every row of versions, rows without findings included; repeated rows each. A null text has
        none. An empty table gives an empty one."""
        paths = versions.select(*keys, blob_id(F.col(text_col)).alias("blob"))
        # The findings are dealt anew, so that both sides of the join are shuffled for it and a blob of very many paths can be split.
        found = self.by_blob(findings).repartition(int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        joined = paths.join(found.hint("merge"), "blob", "left")
        return joined.select(*keys, *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in self.rules], F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("base_spans", F.lit("")).alias("base_spans"))


class Store:
    """A ledger and its findings as Parquet tables in a folder that the cluster shares; they outlive the session."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else None

    def ledger(self) -> DataFrame | None:
        return self._table("ledger", LEDGER)

    def findings(self) -> DataFrame | None:
        return self._table("findings", FINDINGS)

    def update(self, scan: SecretScan, versions: DataFrame, text_col: str = "text") -> DataFrame:
        """Scan what the ledger lacks, add it, and return all findings. Findings are written before the ledger's rows: a run that broke off
        between them is scanned again."""
        found, scanned = scan.run(versions, self.ledger(), None, text_col)
        if (seen := self.ledger()) is not None:
            scanned = scanned.join(seen, ["blob", "kind", "version"], "left_anti")
        found.write.mode("append").parquet(f"{self.root}/findings")
        scanned.write.mode("append").parquet(f"{self.root}/ledger")
        return self.findings()


def _oracle() -> str:
    ci = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = f"({ci})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    parts = []
    for k, (kind, pattern, group, least) in enumerate((("assign", assign, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))):
        parts.append(
            f"SELECT doc_id, {k} AS place, '{kind}' AS kind, regexp_extract_all(t, '{pattern}', 0) AS found, regexp_extract_all(t, '{pattern}', {group}) AS counted, "
            f"list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps, {least} AS least FROM docs"
        )
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
kept_raw AS (SELECT * FROM raw WHERE len(found) > 0),
each AS (SELECT doc_id, place, kind, least, unnest(found) AS m, unnest(counted) AS c, unnest(gaps[1:len(found)]) AS gap, unnest(range(len(found))) AS k FROM kept_raw),
ends AS (SELECT *, sum(gap + length(m)) OVER (PARTITION BY doc_id, place ORDER BY k ROWS UNBOUNDED PRECEDING) AS e FROM each),
kept AS (SELECT doc_id, place, kind, e - length(m) AS s, e FROM ends WHERE length(c) >= least),
by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access, count(*) FILTER (WHERE place = 2) AS n_hex,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place) AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN by_doc USING (doc_id)
"""


ORACLE = _oracle()
