"""Gradient-boosted regression trees for a 0/1 label, on binned features (numpy)."""

from __future__ import annotations

import numpy as np

TREES, DEPTH, RATE, CUTS = 40, 4, 0.25, 24
SMALLEST, RIDGE = 5.0, 1.0


class Boosted:
    """Trees as arrays: node i splits on ``feature`` at ``cut`` into nodes 2i+1 and 2i+2."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        inner = 2 ** DEPTH - 1
        self.feature = np.zeros((TREES, inner), np.int32)
        self.cut = np.full((TREES, inner), np.inf, np.float32)
        self.leaf = np.zeros((TREES, inner + 1), np.float32)
        z = np.full(n, self.base)
        bins = CUTS + 1
        for t in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p) + 1e-6
            node = np.zeros(n, np.int64)
            for depth in range(DEPTH):
                first, count = 2 ** depth - 1, 2 ** depth
                local = node - first
                best = np.full(count, 1e-9)
                total_g, total_h = np.bincount(local, g, count), np.bincount(local, h, count)
                parent = total_g ** 2 / (total_h + RIDGE)
                for j in range(m):
                    if not len(cuts[j]):
                        continue
                    key = local * bins + binned[:, j]
                    left_g = np.cumsum(np.bincount(key, g, count * bins).reshape(count, bins), 1)[:, :-1]
                    left_h = np.cumsum(np.bincount(key, h, count * bins).reshape(count, bins), 1)[:, :-1]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g ** 2 / (left_h + RIDGE) + right_g ** 2 / (right_h + RIDGE) - parent[:, None]
                    gain[(left_h < SMALLEST * 0.05) | (right_h < SMALLEST * 0.05)] = 0
                    gain = gain[:, :len(cuts[j])]
                    k = gain.argmax(1)
                    value = gain[np.arange(count), k]
                    for i in np.flatnonzero(value > best):
                        best[i] = value[i]
                        self.feature[t, first + i], self.cut[t, first + i] = j, cuts[j][k[i]]
                node = 2 * node + 1 + (x[np.arange(n), self.feature[t, node]] > self.cut[t, node])
            leaf = node - inner
            self.leaf[t] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
            z += self.leaf[t, leaf]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            z += self.leaf[t, node - self.feature.shape[1]]
        return z
