"""Histogram gradient-boosted trees for two classes, flattened into arrays.

Trees are complete to a fixed depth, in heap order: the children of node ``i`` are
``2 i + 1`` and ``2 i + 2``. Scoring walks all rows one level at a time with array
look-ups. Fitting sees the training matrix that it is given, nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); +inf sends every row left
    leaf: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        rows = np.arange(len(x))
        margin = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - inner]
        return _sigmoid(margin)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def constant(p: float) -> Trees:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return Trees(float(np.log(p / (1 - p))), np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper borders of all bins but the last, per feature."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(c, at, method="lower")) for c in x.T]


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    l2: float = 1.0,
    min_weight: float = 1.0,
) -> Trees:
    """Boosting on the logistic loss; ``y`` holds 0 and 1."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    edges = _edges(x, bins)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    n, width = binned.shape
    base = constant(float(y.mean())).base
    margin = np.full(n, base)
    inner = 2**depth - 1
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, 2**depth))
    for t in range(trees):
        p = _sigmoid(margin)
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cells = (count, bins)
            best = np.full(count, 1e-7)
            split_feature, split_bin = np.zeros(count, dtype=np.int64), np.full(count, bins, dtype=np.int64)
            for f in range(width):
                at = node * bins + binned[:, f]
                gl = np.bincount(at, g, count * bins).reshape(cells).cumsum(axis=1)
                hl = np.bincount(at, h, count * bins).reshape(cells).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < min_weight) | (ht - hl < min_weight)] = -1
                gain[:, len(edges[f]):] = -1
                b = gain.argmax(axis=1)
                value = gain[np.arange(count), b]
                better = value > best
                best[better], split_feature[better], split_bin[better] = value[better], f, b[better]
            for k in np.flatnonzero(split_bin < bins):
                feature[t, first + k] = split_feature[k]
                threshold[t, first + k] = edges[split_feature[k]][split_bin[k]]
            node = 2 * node + (binned[np.arange(n), split_feature[node]] > split_bin[node])
        total_g = np.bincount(node, g, 2**depth)
        total_h = np.bincount(node, h, 2**depth)
        leaf[t] = -rate * total_g / (total_h + l2)
        margin += leaf[t][node]
    return Trees(base, feature, threshold, leaf)
