"""Gradient-boosted trees in numpy, for small tables of features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting with trees of a fixed depth, on features cut into bins. ``score`` gives log-odds, ``probability`` calibrated ones."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 5.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[list[tuple[np.ndarray, np.ndarray] | np.ndarray]] = []
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")) for c in x.T]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(binned, p - y, p * (1 - p) + 1e-6)
            self.trees.append(tree)
            score += tree[-1][leaf]
        return self

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[list, np.ndarray]:
        """A level of splits for each depth (feature and bin of every node), then the leaf values."""
        tree, node, width = [], np.zeros(len(grad), np.int64), binned.shape[1]
        for level in range(self.depth):
            nodes = 1 << level
            best, feature, cut = np.full(nodes, 1e-6), np.zeros(nodes, np.int64), np.full(nodes, 255, np.int64)
            for f in range(width):
                at = node * 256 + binned[:, f]
                g = np.bincount(at, grad, nodes * 256).reshape(nodes, 256).cumsum(axis=1)
                h = np.bincount(at, hess, nodes * 256).reshape(nodes, 256).cumsum(axis=1)
                whole_g, whole_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (whole_g - g) ** 2 / (whole_h - h + 1) - whole_g**2 / (whole_h + 1)
                gain[(h < self.least * 0.05) | (whole_h - h < self.least * 0.05)] = -1
                k = gain.argmax(axis=1)
                top = gain[np.arange(nodes), k]
                up = top > best
                best[up], feature[up], cut[up] = top[up], f, k[up]
            tree.append((feature, cut))
            node = node * 2 + (binned[np.arange(len(node)), feature[node]] > cut[node])
        leaves = 1 << self.depth
        tree.append(-self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + 1))
        return tree, node

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for *levels, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in levels:
                node = node * 2 + (binned[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling on rows that the trees have not seen."""
        z = self.score(x)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            w = p * (1 - p) + 1e-6
            g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum()])
            h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(h, g)
            a, b = a - float(step[0]), b - float(step[1])
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = a, b
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.score(x) + self.shift, -50, 50))) if len(x) else np.zeros(0)
