"""Gradient-boosted trees for a yes or no, in numpy: logistic loss, binned features, level by level."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    def __init__(self, rounds: int = 150, depth: int = 4, rate: float = 0.2, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        n_features = x.shape[1]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            slope, bend = y - p, p * (1 - p)
            at = np.zeros(len(y), "int64")  # node within the level
            feature = np.zeros(2**self.depth - 1, "int64")
            limit = np.full(2**self.depth - 1, np.inf)  # go right above it
            for level in range(self.depth):
                nodes = 2**level
                cell = ((at[:, None] * n_features + np.arange(n_features)) * BINS + binned).ravel()
                g = np.bincount(cell, np.repeat(slope, n_features), nodes * n_features * BINS).reshape(nodes, n_features, BINS)
                h = np.bincount(cell, np.repeat(bend, n_features), nodes * n_features * BINS).reshape(nodes, n_features, BINS)
                gl, hl = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                best = gain.reshape(nodes, -1).argmax(axis=1)
                f, b = best // BINS, best % BINS
                for k in range(nodes):
                    if gain[k, f[k], b[k]] > 1e-6 and b[k] < len(edges[f[k]]):
                        feature[nodes - 1 + k], limit[nodes - 1 + k] = f[k], edges[f[k]][b[k]]
                here = nodes - 1 + at
                at = 2 * at + (x[np.arange(len(y)), feature[here]] > limit[here])
            leaves = 2**self.depth
            leaf = self.rate * np.bincount(at, slope, leaves) / (np.bincount(at, bend, leaves) + self.ridge)
            score += leaf[at]
            self.trees.append((feature, limit, leaf))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in self.trees:
            at = np.zeros(len(x), "int64")
            for level in range(self.depth):
                here = 2**level - 1 + at
                at = 2 * at + (x[rows, feature[here]] > limit[here])
            score += leaf[at]
        return 1 / (1 + np.exp(-score))
