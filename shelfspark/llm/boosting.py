"""Gradient-boosted trees for two classes, in numpy: histogram splits, complete trees of fixed depth, Platt calibration."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """``rounds`` trees of depth ``depth`` on the logistic loss; ``predict`` gives calibrated probabilities."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.3, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.ridge = depth, rounds, rate, ridge
        self.base, self.trees, self.slope, self.offset = 0.0, [], 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)])
        score = np.full(n, self.base)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                place = node - first
                best = np.zeros(count)
                for j in range(width):
                    if not len(cuts[j]):
                        continue
                    key = place * (BINS + 1) + binned[j]
                    g = np.bincount(key, gradient, count * (BINS + 1)).reshape(count, -1).cumsum(1)
                    h = np.bincount(key, weight, count * (BINS + 1)).reshape(count, -1).cumsum(1)
                    left, right = g[:, :len(cuts[j])], g[:, -1:] - g[:, :len(cuts[j])]
                    hl, hr = h[:, :len(cuts[j])], h[:, -1:] - h[:, :len(cuts[j])]
                    gain = left ** 2 / (hl + self.ridge) + right ** 2 / (hr + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                    at = gain.argmax(1)
                    top = gain[np.arange(count), at]
                    better = np.flatnonzero(top > best + 1e-9)
                    best[better] = top[better]
                    feature[first + better] = j
                    cut[first + better] = cuts[j][at[better]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, gradient, 1 << self.depth) / (np.bincount(leaf, weight, 1 << self.depth) + self.ridge)
            self.trees.append((feature, cut, value))
            score = score + value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += value[node - (len(value) - 1)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> BoostedTrees:
        """Platt scaling on rows that were not trained on (Newton steps on slope and offset)."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([((target - p) * m).sum() - 1e-3 * a, (target - p).sum()])
            h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
        self.slope, self.offset = float(a), float(b)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))
