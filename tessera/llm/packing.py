"""Packing of token sequences into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows. What is left of each is sorted by length, longest first,
and goes to the open window of the least remaining capacity that holds it; a segment tree over capacities finds it.
Token ids are needed once, for the checksums of the pieces, whose bounds depend on lengths alone; packing then moves
lengths only. Every partition packs its own pieces in a stream, so that memory holds the open windows' numbers only.
"""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordTokenizer

WINDOW, END_ID = 2048, 1
#: Texts that are tokenised together, in characters.
GROUP_CHARS = 2_000_000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree whose nodes count the windows below them."""

    def __init__(self, window: int):
        self.leaf = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaf)
        self.at: dict[int, list] = {}

    def _add(self, capacity: int, by: int) -> None:
        k, count = self.leaf + capacity, self.count
        while k:
            count[k] += by
            k >>= 1

    def push(self, capacity: int, item) -> None:
        self.at.setdefault(capacity, []).append(item)
        self._add(capacity, 1)

    def pop_tightest(self, need: int):
        """(capacity, item) of the least capacity >= need, the latest such window first, or None."""
        k, count = self.leaf + need, self.count
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # climb until a right sibling has any
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaf:
                k = 2 * k if count[2 * k] else 2 * k + 1
        capacity = k - self.leaf
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit(lengths, window: int = WINDOW):
    """(window number, offset) for each length, in the order given."""
    opened, number = OpenWindows(window), 0
    for n in lengths:
        found = opened.pop_tightest(n)
        if found is None:
            found, number = (window, number), number + 1
        capacity, item = found
        yield item, window - capacity
        if capacity > n:
            opened.push(capacity - n, item)


def _pieces(tokenizer_path: str, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(ids, texts, tokenizer):
        out = [[] for _ in range(5)]
        for doc, data in zip(ids, tokenizer.ids(texts)):
            data += end
            n = len(data) // 4
            for start in range(0, n, window):
                part = data[4 * start : 4 * (start + window)]
                for column, x in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n)):
                    column.append(x)
        return pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    def run(batches):
        tokenizer = WordTokenizer(tokenizer_path)
        gc.freeze()  # the vocabulary stays; no cycles arise below
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= GROUP_CHARS:
                    yield cut(ids, texts, tokenizer)
                    ids, texts, size = [], [], 0
            if ids:
                yield cut(ids, texts, tokenizer)

    return run


def _placed(window: int):
    def run(batches):
        base = TaskContext.get().partitionId() << 40
        lengths: list = []

        def stream():
            while True:
                yield lengths.pop()

        places = best_fit(stream(), window)
        for batch in batches:
            sequence, offset = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, n in enumerate(batch.column("length").to_pylist()):
                lengths.append(n)
                sequence[k], offset[k] = next(places)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence + base), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids, end_id last, cut at multiples of the window."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer_path, window, end_id), _PIECES)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    A null text is an empty one and has the end id only. Repeated rows are packed each. A null id stays null. Other
    columns are ignored. Of equal lengths the smaller (doc_id, start, checksum) is placed first. An empty table gives an
    empty one."""
    cut = pieces(docs, tokenizer_path, window, end_id)
    order = [F.desc("length"), "doc_id", "start", "ids_crc32"]
    dealt = cut.repartition(F.xxhash64("doc_id", "start", "ids_crc32")).sortWithinPartitions(*order)
    return dealt.mapInArrow(_placed(window), _PIECES + ", sequence_id long, offset long")
