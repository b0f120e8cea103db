"""Gradient-boosted trees over dense features, and isotonic calibration, in numpy.

For models fitted on a bounded sample on the driver and applied to Arrow batches.
"""

from __future__ import annotations

import numpy as np


def _bin(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1).astype(np.uint8)


class BoostedTrees:
    """Binary logistic boosting with histogram splits; trees of fixed depth, stored as arrays."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        b = _bin(x, self.edges).astype(np.int64)
        p0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = np.log(p0 / (1 - p0))
        f = np.full(n, self.start)
        flat = b + np.arange(d) * self.bins  # cell of each feature in a node's histogram
        self.nodes = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            leaf = np.zeros(n, np.int64)
            feature, cut = np.full((1 << self.depth) - 1, -1), np.zeros((1 << self.depth) - 1, np.int64)
            for level in range(self.depth):
                width = 1 << level
                cell = (leaf[:, None] * (d * self.bins) + flat).ravel()
                shape, size = (width, d, self.bins), width * d * self.bins
                hg, hh, hn = (np.bincount(cell, np.repeat(w, d) if w is not None else None, size).reshape(shape).cumsum(2) for w in (g, h, None))
                tg, th, tn = hg[:, :1, -1:], hh[:, :1, -1:], hn[:, :1, -1:]
                gain = hg**2 / (hh + self.ridge) + (tg - hg) ** 2 / (th - hh + self.ridge) - tg**2 / (th + self.ridge)
                gain[(hn < self.least) | (tn - hn < self.least)] = 0
                best = gain.reshape(width, -1).argmax(1)
                good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                at = slice(width - 1, 2 * width - 1)
                feature[at], cut[at] = np.where(good, best // self.bins, 0), np.where(good, best % self.bins, self.bins)
                leaf = leaf * 2 + (b[np.arange(n), feature[at][leaf]] > cut[at][leaf])
            size = 1 << self.depth
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge)
            self.nodes.append((feature, cut, value))
            f += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = _bin(x, self.edges), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.nodes:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + (1 << level) - 1
                node = node * 2 + (b[rows, feature[at]] > cut[at])
            f += value[node]
        return f


class Isotonic:
    """Non-decreasing map of scores to probabilities (pool adjacent violators), linear between steps."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        s, where = np.unique(score, return_inverse=True)
        weight, total = np.bincount(where).astype(float), np.bincount(where, y)
        mean, w, lo, hi = [], [], [], []
        for x, k, t in zip(s, weight, total):
            mean.append(t / k), w.append(k), lo.append(x), hi.append(x)
            while len(mean) > 1 and mean[-2] >= mean[-1]:
                m = (mean[-2] * w[-2] + mean[-1] * w[-1]) / (w[-2] + w[-1])
                mean[-2:], w[-2:], lo[-2:], hi[-2:] = [m], [w[-2] + w[-1]], [lo[-2]], [hi[-1]]
        # A step of few rows is drawn towards the overall rate.
        base = float(y.mean())
        m = [(a * k + base) / (k + 1) for a, k in zip(mean, w)]
        self.x = np.array([v for pair in zip(lo, hi) for v in pair])
        self.y = np.maximum.accumulate(np.repeat(m, 2))
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
