"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. Its features are statistics of its own bytes, of the lines before and after it and of the
whole document. Training knows documents' labels only: lines start with their document's label, and in rounds the lines of
bad documents that the field holds good are relabelled, one bad line at least staying in each. A document's quality is the
mean of its lines' forward-backward marginals, weighted by length, sent through a logistic curve fitted to the training labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash
from .texthash import parts

#: Labelled documents used for training at most, per label, in the order of a hash of the id; their lines at most, evenly cut.
TRAIN_PER_LABEL, TRAIN_LINES = 500, 60_000
#: Characters of the training documents together.
TRAIN_CHARS = 20_000_000
EPOCHS, ROUNDS = 60, 3

_CLASSES = {
    "letters": [*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0xC3, 0xF5)],
    "upper": [*range(0x41, 0x5B)],
    "symbols": [ord(c) for c in "#*$%&<>^~\\@"],
    "bars": [ord(c) for c in "|"],
    "shouts": [ord(c) for c in "!"],
    "stops": [ord(c) for c in ".?,;:"],
    "digits": [*range(0x30, 0x3A)],
    "others": [ord(c) for c in "\"'()[]{}=_/+-"],
    "blanks": [0x20, 9, 11, 12, 13],
}
_TABLES = []
for _codes in _CLASSES.values():
    _t = np.zeros(256, np.uint8)
    _t[_codes] = 1
    _TABLES.append(_t)
N_OWN = len(_TABLES) + 6
N_FEATURES = 4 * N_OWN + 1


def line_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, first line of each text and the number of lines). Blank lines are no lines; a text without lines has an empty one."""
    n = len(off) - 1
    newline = np.flatnonzero(raw == 10)
    starts = np.union1d(newline + 1, off[:-1][np.diff(off) > 0]) if len(raw) else np.zeros(0, np.int64)
    starts = starts[starts < len(raw)]
    doc = np.searchsorted(off, starts, "right") - 1
    stop_nl = np.append(newline, len(raw))[np.searchsorted(newline, starts)] if len(starts) else starts
    ends = np.minimum(stop_nl, off[doc + 1]) if len(starts) else starts
    totals = [np.concatenate([[0], np.cumsum(t[raw], dtype=np.int64)]) for t in _TABLES]
    counts = np.stack([c[ends] - c[starts] for c in totals], 1).astype(float) if len(starts) else np.zeros((0, len(_TABLES)))
    words, word_at = texthash.word_hashes(raw, np.append(starts, len(raw)), fold=False) if len(starts) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    line_of = np.repeat(np.arange(len(starts)), np.diff(word_at))
    stutter = np.flatnonzero((words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])) + 1
    counts = np.concatenate([np.bincount(line_of[stutter], minlength=len(starts))[:, None] / (np.diff(word_at)[:, None] + 3.0), counts], 1)
    size = (ends - starts).astype(float)
    full = size - counts[:, -1] > 0
    missing = np.setdiff1d(np.arange(n), doc[full])
    starts, ends, doc, counts, size = (np.concatenate([x[full], fill]) for x, fill in ((starts, off[missing]), (ends, off[missing]), (doc, missing), (counts, np.zeros((len(missing), len(_TABLES) + 1))), (size, np.zeros(len(missing)))))
    order = np.lexsort((starts, doc))
    starts, ends, doc, counts, size = (x[order] for x in (starts, ends, doc, counts, size))
    first = np.searchsorted(doc, np.arange(n + 1))
    data, again = raw.tobytes(), np.zeros(len(starts))
    for a, b in zip(first[:-1], first[1:]):
        if b - a > 1:
            seen = set()
            for k in range(a, b):
                line = data[starts[k] : ends[k]]
                again[k] = line in seen
                seen.add(line)
    own = np.concatenate([counts[:, :1], np.log1p(200 * counts[:, 1:-1] / (size[:, None] + 20)), (counts[:, -1:] + 1) / (size[:, None] + 8), again[:, None], np.log1p(size)[:, None] / 5, (np.log1p(counts[:, 2]) - np.log1p(counts[:, 1]))[:, None], (size == 0)[:, None], (size < 60)[:, None]], 1)
    head, tail = np.ones(len(own), bool), np.ones(len(own), bool)
    head[1:], tail[:-1] = doc[1:] != doc[:-1], doc[1:] != doc[:-1]
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[head], after[tail] = 0, 0
    weight = size + 1
    mean = np.stack([np.bincount(doc, weight * c, n) for c in own.T], 1) / np.bincount(doc, weight, n)[:, None] if n else own
    return np.concatenate([own, before, after, mean[doc], np.ones((len(own), 1))], 1), weight, first


def _logsum(a, b):
    return np.logaddexp(a, b)


def marginals(emit: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) per line, expected moves 2x2, log partition of all chains) for chains laid end to end; emit: score of good, bad has 0.

    Chains advance together, longest first, so that a step is one operation over all chains that still go on."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    alpha = np.zeros((len(emit), 2))
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]  # chains longer than t
    for t in range(steps):
        at = begin[: active[t]] + t
        if t == 0:
            alpha[at, 1] = emit[at]
        else:
            old = alpha[at - 1]
            alpha[at, 0] = _logsum(old[:, 0] + moves[0, 0], old[:, 1] + moves[1, 0])
            alpha[at, 1] = _logsum(old[:, 0] + moves[0, 1], old[:, 1] + moves[1, 1]) + emit[at]
    beta = np.zeros((len(emit), 2))
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        new = beta[at + 1]
        beta[at, 0] = _logsum(moves[0, 0] + new[:, 0], moves[0, 1] + emit[at + 1] + new[:, 1])
        beta[at, 1] = _logsum(moves[1, 0] + new[:, 0], moves[1, 1] + emit[at + 1] + new[:, 1])
    both = alpha + beta
    z = _logsum(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    expected = np.zeros((2, 2))
    inner = np.ones(len(emit), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    for a in (0, 1):
        for b in (0, 1):
            expected[a, b] = np.exp(alpha[at - 1, a] + moves[a, b] + b * emit[at] + beta[at, b] - z[at]).sum()
    return good, expected, float(z[first[:-1]].sum())


class LineField:
    def __init__(self):
        self.centre, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.weights, self.moves = np.zeros(N_FEATURES), np.zeros((2, 2))
        self.curve = (1.0, 0.0)

    def _fit_lines(self, x, labels, first):
        inner = np.ones(len(x), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[at - 1], labels[at]), 1)
        params = np.concatenate([self.weights, self.moves.ravel()])
        m, v = np.zeros_like(params), np.zeros_like(params)
        for k in range(1, EPOCHS + 1):  # Adam on the mean log likelihood, with a ridge
            good, expected, _ = marginals(x @ params[:-4], params[-4:].reshape(2, 2), first)
            grad = np.concatenate([x.T @ (labels - good), (seen - expected).ravel()]) / len(x) - 1e-4 * params
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            params += 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.weights, self.moves = params[:-4], params[-4:].reshape(2, 2)

    def fit(self, texts: list[str | None], labels: list[int]) -> "LineField":
        if not texts or len(set(labels)) < 2:
            self.curve = (0.0, 3.0 if labels and labels[0] else (-3.0 if labels else 0.0))
            return self
        x, weight, first = line_features(*texthash.buffers(pa.array(texts, pa.string())))
        y = np.array(labels)
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-3
        self.centre[-1], self.scale[-1] = 0, 1
        x = (x - self.centre) / self.scale
        of = np.repeat(np.arange(len(y)), np.diff(first))
        lines = y[of].astype(int)
        for k in range(ROUNDS):
            self._fit_lines(x, lines, first)
            if k + 1 < ROUNDS:
                good, _, _ = marginals(x @ self.weights, self.moves, first)
                lines = np.where((y[of] == 0) & (good > 0.9), 1, y[of])
                worst = np.lexsort((good, of))[np.searchsorted(of, np.arange(len(y)))]
                lines[worst[y == 0]] = 0
        raw = self._raw(x, weight, first)
        a, b = 1.0, 0.0
        for _ in range(200):  # logistic curve by Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            g = np.array([((y - p) * raw).sum() - 0.01 * a, (y - p).sum() - 0.01 * b])
            w = p * (1 - p) + 1e-6
            h = np.array([[(w * raw * raw).sum() + 0.01, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.01]])
            step = np.linalg.solve(h, g)
            a, b = a + np.clip(step[0], -0.5, 0.5), b + np.clip(step[1], -0.5, 0.5)
        self.curve = (float(a), float(b))
        return self

    def _raw(self, x, weight, first):
        good, _, _ = marginals(x @ self.weights, self.moves, first)
        share = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        share = np.clip(share, 1e-4, 1 - 1e-4)
        return np.log(share / (1 - share))

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        x, weight, first = line_features(*texthash.buffers(column))
        raw = self._raw((x - self.centre) / self.scale, weight, first)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, usable, per_label: int = TRAIN_PER_LABEL) -> LineField:
    """Train on documents where `usable` (over doc_id) holds and labels.quality is 0 or 1: ids first, whole texts for these only."""
    known = labels.where(usable & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    chosen = {}
    for y in (0, 1):
        for r in known.where(F.col("low") == y).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(per_label).select("doc_id").collect():
            chosen[r[0]] = y
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.where(F.col("doc_id").isin(list(chosen))).select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    sizes = rows.select("doc_id", "h", F.length("text").alias("chars"), (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("lines")).distinct()
    kept, lines, chars = [], 0, 0
    for r in sizes.orderBy("lines", "chars", "doc_id", "h").limit(2 * per_label).collect() if chosen else []:  # many-lined texts last: the bounds leave them out
        lines, chars = lines + r.lines, chars + r.chars
        if lines > TRAIN_LINES or chars > TRAIN_CHARS:
            break
        kept.append((r.doc_id, r.h))
    if not kept:
        return LineField().fit([], [])
    picked = docs.sparkSession.createDataFrame(kept, rows.select("doc_id", "h").schema)
    found = rows.where(F.col("doc_id").isin([d for d, _ in kept])).join(F.broadcast(picked), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).collect()
    kept = [(r.doc_id, r.text) for r in sorted(found, key=lambda r: (r.text.count("\n"), r.doc_id, r.text))]
    return LineField().fit([t for _, t in kept], [chosen[d] for d, _ in kept])


def score(docs: DataFrame, model: LineField) -> DataFrame:
    """(doc_id, score), one row per row of docs; score is the probability that the text is good.

    A null text is an empty one; that is scored as one empty line. Repeated rows and null ids stay. Other columns are
    ignored. An empty table gives an empty one."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
