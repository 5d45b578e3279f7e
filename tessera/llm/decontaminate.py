"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to lower-case words between single blanks. Each window of 13 consecutive words of a test item, or the
whole of a shorter item, is one pattern ` w1 ... w13 `; a text is scanned once for all of them. A UTF-8 text normalises
byte by byte through one translation table, and hits are mapped back to words and to offsets of the original.

The patterns are a table made by the workers. An automaton holds MAX_PATTERN_BYTES of them at most. A larger table is dealt by
hash into blocks under that bound; the texts are scanned for one block after the other, of which the driver holds one at a
time, and the hits are merged by row. The verdicts are the same for any number of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .texthash import buffers, parts

WINDOW = 13
#: Bytes of patterns and item ids of one block; an automaton takes some 40 times as much memory.
MAX_PATTERN_BYTES = 8 << 20
#: Contaminated from this share of hit words on, as a fraction 1 / SHARE.
SHARE = 20

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z; all others become blanks.
_TABLE = np.full(256, 32, np.uint8)
for _a, _b, _shift in ((0x30, 0x3A, 0), (0x61, 0x7B, 0), (0x41, 0x5B, 32), (0x80, 0x100, 0)):
    _TABLE[_a:_b] = np.arange(_a, _b) + _shift
_TABLE_BYTES = _TABLE.tobytes()

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE_BYTES).split()


def windows(text: str | None, window: int = WINDOW) -> dict[bytes, int]:
    """Pattern -> its number of words."""
    words, found = words_of(text), {}
    for k in range(max(1, len(words) - window + 1) if words else 0):
        part = words[k : k + window]
        found[b" " + b" ".join(part) + b" "] = len(part)
    return found


def _windows(window: int):
    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = windows(text, window)
                yield pa.record_batch({"pattern": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int32()), "item": pa.array([item] * len(found), pa.string())})

    return run


class Blocks:
    """The patterns of a benchmark in blocks of max_bytes at most, as a table; block(k): pattern -> (words, item ids)."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_PATTERN_BYTES):
        items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null")
        each = items.mapInArrow(_windows(window), "pattern binary, n int, item string")
        found = each.groupBy("pattern", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))
        self.scratch = Scratch(spark, "benchmark")
        self.table = self.scratch.keep(found.withColumn("bytes", F.octet_length("pattern") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x))), "patterns")
        total, self.most = self.table.agg(F.sum("bytes"), F.max("bytes")).first()
        self.spark, self.count = spark, max(1, -(-(total or 0) // max_bytes))
        if self.count > 1:  # blocks dealt by hash differ a little
            self.count = -(-self.count * 5 // 4)

    def block(self, k: int) -> dict[bytes, tuple[int, list[str]]]:
        own = self.table if self.count == 1 else self.table.where(F.pmod(F.xxhash64("pattern"), F.lit(self.count)) == k)
        return {bytes(r.pattern): (r.n, r["items"]) for r in own.select("pattern", "n", "items").toLocalIterator()}


class Scanner:
    """One automaton; scan(raw text) -> (number of words, bool per word, item ids)."""

    def __init__(self, found: dict[bytes, tuple[int, list[str]]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, value in found.items():
            self.automaton.add_word(p.decode("latin-1"), value)
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def scan(self, raw: bytes) -> tuple[int, np.ndarray | None, set]:
        words = raw.translate(_TABLE_BYTES).split()
        if self.empty or not words:
            return len(words), None, set()
        text = b" ".join((b"", *words, b"")).decode("latin-1")
        hits = list(self.automaton.iter(text))
        if not hits:
            return len(words), None, set()
        blanks = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        last = np.searchsorted(blanks, np.array([end for end, _ in hits]))  # the word before this blank ends the pattern
        change = np.zeros(len(words) + 1, np.int64)
        size = np.array([n for _, (n, _) in hits])
        np.add.at(change, last - size, 1)
        np.add.at(change, last, -1)
        return len(words), np.cumsum(change[:-1]) > 0, {i for _, (_, ids) in hits for i in ids}


def hit_spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) in code points of the original for each run of hit words, from its first word to its last."""
    b = np.frombuffer(raw, np.uint8)
    inside = _TABLE[b] != 32
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    point = np.cumsum((b & 0xC0) != 0x80)  # code points that begin up to each byte
    run = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return [(int(point[start[x]]) - 1, int(point[end[y] - 1])) for x, y in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1)]


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def _texts(batches, text_at: int):
    """(slice of a batch, its texts in UTF-8), some MB at a time."""
    for batch in batches:
        for part in parts(batch, text_at):
            raw, off = buffers(part.column(text_at))
            data = raw.tobytes()
            yield part, [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


_SPANS = pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))


def _scan(shipped):
    def run(batches):
        scanner = Scanner(shipped.value)
        for batch, texts in _texts(batches, 1):
            out = [[] for _ in range(5)]
            for text in texts:
                n, hit, items = scanner.scan(text)
                n_hit = 0 if hit is None else int(hit.sum())
                spans = [] if hit is None else [{"start": s, "end": e} for s, e in hit_spans(text, hit)]
                for column, x in zip(out, (n, n_hit, sorted(items), spans, contaminated(n_hit, n))):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"])

    return run


def _scan_part(shipped):
    """Hits of one block: (k1, k2, number of words, words hit, items) of the rows that have any."""

    def run(batches):
        scanner = Scanner(shipped.value)
        for batch, texts in _texts(batches, 1):
            rows, n_words, hits, items = [], [], [], []
            for k, text in enumerate(texts):
                n, hit, found = scanner.scan(text)
                if found:
                    rows.append(k)
                    n_words.append(n)
                    hits.append(np.flatnonzero(hit))
                    items.append(sorted(found))
            keys = batch.take(pa.array(rows, pa.int64()))
            yield pa.record_batch({"k1": keys.column(2), "k2": keys.column(3), "n_words": pa.array(n_words, pa.int64()), "words": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))})

    return run


def _finish(batches):
    for batch, texts in _texts(batches, 1):
        out = [[] for _ in range(5)]
        for text, words, items in zip(texts, batch.column(2), batch.column(3).to_pylist()):
            n = len(text.translate(_TABLE_BYTES).split())
            at = words.values.to_numpy() if words.is_valid else np.zeros(0, int)
            hit = np.zeros(n, bool)
            hit[at] = True
            spans = [{"start": s, "end": e} for s, e in hit_spans(text, hit)] if len(at) else []
            for column, x in zip(out, (n, len(at), items or [], spans, contaminated(len(at), n))):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"])


def _marks() -> dict:
    """Two hashes of id and text address a row; rows equal in both get one verdict."""
    return {"__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64(F.lit(1), "text", "doc_id")}


def _merged(spark: SparkSession, rows: DataFrame, blocks: Blocks) -> DataFrame:
    """(k1, k2, n_words, words, items) of the rows with hits in any block. rows: (doc_id, text, k1, k2). One automaton is shipped at a time."""
    found = None
    for k in range(blocks.count):
        shipped = spark.sparkContext.broadcast(blocks.block(k))
        part = blocks.scratch.keep(rows.mapInArrow(_scan_part(shipped), "k1 long, k2 long, n_words long, words array<int>, items array<string>"), "hits")
        shipped.destroy()
        found = part if found is None else found.unionByName(part)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)  # noqa: E731  one row a block and text
    return found.groupBy("k1", "k2").agg(F.first("n_words").alias("n_words"), union("words"), union("items"))


def scan_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated), one row per row of docs.

    A null text has no words and isn't contaminated; so has an item without words no windows. A null item id is left out; items that share
    an id count as one. Rows that repeat an id are judged each. Texts are scanned whole, however long. Other columns are ignored. Spans
    are code points of the original. An empty benchmark hits nothing; an empty table gives an empty one."""
    rows, blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), Blocks(spark, benchmark, window, max_bytes)
    if blocks.count == 1:
        return rows.mapInArrow(_scan(spark.sparkContext.broadcast(blocks.block(0))), SCHEMA)
    keyed = rows.select("doc_id", "text", *[c.alias(k.strip("_")) for k, c in _marks().items()])
    joined = keyed.join(_merged(spark, keyed, blocks).select("k1", "k2", "words", "items"), ["k1", "k2"], "left")
    return joined.select("doc_id", "text", "words", "items").mapInArrow(_finish, SCHEMA)


def _keep_clean(shipped):
    def run(batches):
        scanner, text_at = Scanner(shipped.value), None
        for whole in batches:
            text_at = whole.schema.get_field_index("text")
            for batch, texts in _texts([whole], text_at):
                keep = []
                for text in texts:
                    n, hit, _ = scanner.scan(text)
                    keep.append(not contaminated(0 if hit is None else int(hit.sum()), n))
                yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """docs without the contaminated rows, each judged by its own text; all columns stay, names that start with two underscores
    being this function's. A null text isn't contaminated; repeated rows and null ids are judged each. While the patterns fit one automaton this
    needs no shuffle. An empty table gives an empty one."""
    blocks = Blocks(spark, benchmark, window, max_bytes)
    if blocks.count == 1:
        return docs.mapInArrow(_keep_clean(spark.sparkContext.broadcast(blocks.block(0))), docs.schema)
    keyed = docs.select("doc_id", "text", *[c.alias(k.strip("_")) for k, c in _marks().items()])
    bad = _merged(spark, keyed, blocks).where((F.size("words") > 0) & (SHARE * F.size("words") >= F.col("n_words"))).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    return docs.withColumns(_marks()).join(bad, ["__k1", "__k2"], "left_anti").select(*docs.columns)
