"""Gradient-boosted regression trees for a logistic loss, on binned features (numpy only)."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """``fit`` learns ``trees`` trees of ``depth`` levels; ``margin`` gives the log-odds of label 1."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.l2, self.least = trees, depth, rate, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.asarray(x, dtype=np.float32)
        n, k = x.shape
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1], method="lower")) for f in range(k)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)
        flat = binned + np.arange(k) * BINS
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        margin = np.full(n, self.bias)
        nodes = 2**self.depth - 1
        self.feature = np.zeros((self.trees, nodes), dtype=np.int32)
        self.cut = np.full((self.trees, nodes), np.inf, dtype=np.float32)
        self.leaf = np.zeros((self.trees, nodes + 1))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(at == node)
                    if len(rows) < 2:
                        at[rows] = 2 * node + 1
                        continue
                    size = k * BINS
                    cells = flat[rows].ravel()
                    gs = np.bincount(cells, np.repeat(g[rows], k), size).reshape(k, BINS).cumsum(1)
                    hs = np.bincount(cells, np.repeat(h[rows], k), size).reshape(k, BINS).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < self.least) | (ht - hs < self.least)] = -1
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] <= 1e-6 or b >= len(self.cuts[f]):
                        at[rows] = 2 * node + 1
                        continue
                    self.feature[t, node], self.cut[t, node] = f, self.cuts[f][b]
                    at[rows] = 2 * node + 1 + (binned[rows, f] > b)
            last = at - nodes
            gs, hs = np.bincount(last, g, nodes + 1), np.bincount(last, h, nodes + 1)
            self.leaf[t] = -self.rate * gs / (hs + self.l2)
            margin += self.leaf[t][last]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float32)
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in range(self.trees):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t][at]] > self.cut[t][at])
            out += self.leaf[t][at - (2**self.depth - 1)]
        return out
