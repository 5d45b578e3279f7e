"""Language identification by nearest centroids.

A text's letters, lower-cased, with one blank for whatever stands between words, give hashed character trigrams; their TF-IDF
vector of unit length is compared by cosine with several centroids per language, found by spherical k-means among the
training texts of the language. The nearest centroid names the language; a text further from it than the language's own
training texts nearly ever are is marked as rejected.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Training texts per language at most, taken in the order of a hash of the id.
TRAIN_PER_LANGUAGE = 300
DIMENSIONS, CENTROIDS, ROUNDS = 1 << 12, 4, 8
#: Share of a language's training texts beyond its rejection distance.
BEYOND = 0.005


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code point -> its lower-case letter, or 32 if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x41, 0x32400):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low[0])
    return out


PIECE = 1 << 18


def trigram_counts(text: str) -> tuple[np.ndarray, int]:
    """(counts of hashed trigrams, letters) of the whole text; long texts go through piece by piece."""
    total, letters, carry = np.zeros(DIMENSIONS, np.float32), 0, np.full(1, 32, np.uint32)
    fold = _folded()
    for at in range(0, len(text), PIECE):
        codes = fold[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters += int((codes != 32).sum())
        if at + PIECE >= len(text):
            codes = np.append(codes, np.uint32(32))
        codes = np.concatenate([carry, codes])
        blank = codes == 32
        codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
        if len(codes) >= 3:
            h = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA77)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount(h >> np.uint32(20), minlength=DIMENSIONS)
        carry = codes[-2:]
    return total, letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


class Centroids:
    def __init__(self, names: list[str], idf: np.ndarray, centres: np.ndarray, owner: np.ndarray, limit: np.ndarray):
        self.names, self.idf, self.centres, self.owner, self.limit = names, idf, centres, owner, limit

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    @classmethod
    def fit(cls, rows: list[tuple[str, np.ndarray]]) -> "Centroids":
        """rows: (language, trigram counts of a text with letters), in an order that doesn't depend on how the table is dealt out."""
        names = sorted({lang for lang, _ in rows})
        if not names:
            return cls([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
        counts = np.stack([c for _, c in rows])
        idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        x = _unit(np.log1p(counts) * idf)
        of = np.array([names.index(lang) for lang, _ in rows])
        centres, owner, limit = [], [], []
        for k in range(len(names)):
            own = x[of == k]
            mids = own[np.linspace(0, len(own) - 1, min(CENTROIDS, len(own))).astype(int)].copy()
            for _ in range(ROUNDS):
                near = (own @ mids.T).argmax(1)
                for m in range(len(mids)):
                    if (near == m).any():
                        mids[m] = _unit(own[near == m].sum(0))
            centres.append(mids)
            owner += [k] * len(mids)
            limit.append(np.quantile(1 - (own @ mids.T).max(1), 1 - BEYOND))
        return cls(names, idf, np.concatenate(centres).astype(np.float32), np.array(owner), np.array(limit))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, distance, rejected); `und`, 0, 1, true where there is no letter."""
        counts, letters = trigram_counts(text or "")
        if not letters or not self.names:
            return "und", 0.0, 1.0, True
        cosine = self.centres @ self.weigh(counts)
        best = np.array([cosine[self.owner == k].max() for k in range(len(self.names))])
        k = int(best.argmax())
        heat = np.exp(20 * (best - best[k]))
        return self.names[k], float(1 / heat.sum()), float(1 - best[k]), bool(1 - best[k] > self.limit[k])


def _counted(batches):
    for batch in batches:
        found = [trigram_counts(t.as_py()) for t in batch.column(3)]
        letters = pa.array([n for _, n in found], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], letters, pa.array([c.tobytes() for c, _ in found], pa.binary())], names=["lang", "id", "h", "letters", "counts"])


def fit(docs: DataFrame, usable, per_language: int = TRAIN_PER_LANGUAGE, id_col: str = "doc_id") -> Centroids:
    """Train on the rows where `usable` holds and lang isn't null: rows are chosen by hashes of id and text, counted where they are, and only their
    counts (16 KB a row, whatever the text's length) come to the driver, per_language for each language."""
    own = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    own = own.select(F.col("lang").cast("string"), F.col(id_col).cast("string").alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("string"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "h")
    chosen = own.select("lang", "id", "h").withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("lang", "id", "h").distinct()
    keys = chosen.collect()
    if not keys:
        return Centroids.fit([])
    rows = own.where(F.col("id").isin([r.id for r in keys])).join(F.broadcast(docs.sparkSession.createDataFrame(keys, chosen.schema)), ["lang", "id", "h"], "left_semi")
    counts = rows.select("lang", "id", "h", "text").dropDuplicates(["lang", "id", "h"]).mapInArrow(_counted, "lang string, id string, h long, letters long, counts binary")
    found = sorted(counts.where("letters > 0").collect(), key=lambda r: (r.lang, r.h, r.id))
    return Centroids.fit([(r.lang, np.frombuffer(r.counts, np.float32)) for r in found])


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, lang_pred, score, distance, rejected), one row per row of docs.

    A text that is null or has no letter is `und`, with score 0. Repeated rows and null ids stay. Other columns are
    ignored. An empty table gives an empty one."""

    def run(batches):
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], names=["doc_id", "lang_pred", "score", "distance", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, distance double, rejected boolean")
