"""Small gradient-boosted trees for several classes, on numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Softmax boosting; trees of a fixed depth stored as arrays, evaluated for all rows at once."""

    def __init__(self, classes: int, rounds: int = 24, depth: int = 4, rate: float = 0.3, bins: int = 24, least: float = 3.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.least = classes, rounds, depth, rate, bins, least
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n = len(x)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
        score, target = np.zeros((n, self.classes)), np.eye(self.classes)[y]
        for _ in range(self.rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            trees = []
            for k in range(self.classes):
                tree, leaf = self._tree(binned, cuts, p[:, k] - target[:, k], p[:, k] * (1 - p[:, k]) + 1e-6)
                score[:, k] += tree[2][leaf]
                trees.append(tree)
            self.trees.append(trees)
        return self

    def _tree(self, binned, cuts, grad, hess):
        inner = (1 << self.depth) - 1
        feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf)
        node = np.zeros(len(binned), np.int64)
        for level in range(self.depth):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            best = np.full(width, 1e-6)
            total_g, total_h = np.bincount(at, grad, width), np.bincount(at, hess, width)
            split = np.full(width, -1)
            for f in range(binned.shape[1]):
                b = self.bins + 1
                slot = at * b + binned[:, f]
                g = np.bincount(slot, grad, width * b).reshape(width, b).cumsum(1)[:, :-1]
                h = np.bincount(slot, hess, width * b).reshape(width, b).cumsum(1)[:, :-1]
                rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
                gain = g * g / (h + 1) + rest_g * rest_g / (rest_h + 1) - (total_g * total_g / (total_h + 1))[:, None]
                gain[(h < self.least * 0.1) | (rest_h < self.least * 0.1)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                for w in np.flatnonzero((value > best) & (top < len(cuts[f]))):
                    best[w], feature[first + w], threshold[first + w], split[w] = value[w], f, cuts[f][top[w]], top[w]
            right = (split[at] >= 0) & (binned[np.arange(len(binned)), feature[node]] > split[at])
            node = 2 * node + 1 + right
        leaf = node - inner
        size = 1 << self.depth
        value = -self.rate * np.bincount(leaf, grad, size) / (np.bincount(leaf, hess, size) + 1)
        return (feature, threshold, value), leaf

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        score = np.zeros((len(x), self.classes))
        rows, inner = np.arange(len(x)), (1 << self.depth) - 1
        for trees in self.trees:
            for k, (feature, threshold, value) in enumerate(trees):
                node = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
                score[:, k] += value[node - inner]
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))
