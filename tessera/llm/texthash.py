"""Vectorised word and shingle hashing over Arrow string buffers: no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of words `[^\x20\x09-\x0D]+`.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

SEGMENT = 1 << 20
BYTES_AT_ONCE = 1 << 21
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(seed))


BYTE = _table(256, 17)
COEFFICIENT = _table(64, 4711) | np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_ODD, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_ODD, inverse)]
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def parts(batch: pa.RecordBatch, text_at: int):
    """Slices of a batch of about BYTES_AT_ONCE of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
        yield batch.slice(at, to - at)
        at = to


def word_hashes(raw: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, ASCII letters lower-cased if fold, and for each text the index of its first word (one more entry at the end)."""
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    hashes, begins = [], []
    at = 0
    with np.errstate(over="ignore"):
        while at < len(raw):
            to = min(at + SEGMENT, len(raw))
            while to < len(raw):  # cut where no word goes on
                stop = SEPARATOR[raw[to : to + 65536]] | first[to : min(to + 65536, len(raw))]
                if stop.any():
                    to += int(stop.argmax())
                    break
                to = min(to + 65536, len(raw))
            b = LOWER[raw[at:to]] if fold else raw[at:to]
            inside = ~SEPARATOR[b]
            begin = inside.copy()
            begin[1:] &= ~inside[:-1] | first[at + 1 : to]
            end = inside.copy()
            end[:-1] &= ~inside[1:] | first[at + 1 : to]
            s, e = np.flatnonzero(begin), np.flatnonzero(end)
            up, down = _power_tables(max(SEGMENT + 65536, to - at))
            total = np.cumsum(BYTE[b] * up[: to - at])
            h = (total[e] - np.where(s > 0, total[s - 1], np.uint64(0))) * down[s]
            hashes.append(mix(h + (e - s).astype(np.uint64)))
            begins.append(s + at)
            at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), off)


def shingle_sets(column: pa.Array, width: int):
    """For each text the sorted distinct hashes of its shingles of `width` words; fewer words make one shingle, none an empty set."""
    words, at = word_hashes(*buffers(column))
    with np.errstate(over="ignore"):
        n = len(words) - width + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(width if n > 0 else 0):
            rolled += words[k : k + n] * COEFFICIENT[k]
        rolled = mix(rolled)
        for lo, hi in zip(at[:-1], at[1:]):
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif hi > lo:
                yield mix((words[lo:hi] * COEFFICIENT[width : width + hi - lo]).sum(keepdims=True))
            else:
                yield np.zeros(0, np.uint64)
