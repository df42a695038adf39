"""Gradient-boosted trees for two classes over dense features, with isotonic calibration; numpy only."""

from __future__ import annotations

import numpy as np


class Trees:
    """Depth-wise trees on quantile bins, fitted to the logistic loss by second-order gain."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.start, self.edges, self.trees = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
        total = np.full(len(y), self.start)
        for _ in range(self.rounds if len(np.unique(y)) > 1 else 0):
            p = 1 / (1 + np.exp(-total))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            total += self._walk(tree, x)
        return self

    def _grow(self, binned: np.ndarray, grad: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full binary tree in arrays: feature (-1: none), threshold and leaf value by node."""
        count = 2 ** (self.depth + 1) - 1
        feature, limit, value = np.full(count, -1), np.zeros(count), np.zeros(count)
        node = np.zeros(len(grad), int)
        for k in range(count):
            own = np.flatnonzero(node == k)
            if not len(own):
                continue
            g, h = grad[own], curve[own]
            value[k] = -self.rate * g.sum() / (h.sum() + self.ridge)
            if 2 * k + 2 >= count:
                continue
            best = 1e-6
            for f, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                gs = np.bincount(binned[own, f], g, len(edges) + 1).cumsum()[:-1]
                hs = np.bincount(binned[own, f], h, len(edges) + 1).cumsum()[:-1]
                gr, hr = g.sum() - gs, h.sum() - hs
                gain = gs**2 / (hs + self.ridge) + gr**2 / (hr + self.ridge) - g.sum() ** 2 / (h.sum() + self.ridge)
                gain[(hs < self.least / 4) | (hr < self.least / 4)] = 0
                at = int(gain.argmax())
                if gain[at] > best:
                    best, feature[k], limit[k] = gain[at], f, edges[at]
            if feature[k] >= 0:
                right = binned[own, feature[k]] > np.searchsorted(self.edges[feature[k]], limit[k], "left")
                node[own] = 2 * k + 1 + right
        return feature, limit, value

    @staticmethod
    def _walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, limit, value = tree
        node = np.zeros(len(x), int)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return value[node]
            go = x[np.arange(len(x)), np.maximum(f, 0)] > limit[node]
            node = np.where(inner, 2 * node + 1 + go, node)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self._walk(tree, x)
        return out


class Isotonic:
    """The non-decreasing map from margins to rates that fits best (pool adjacent violators), joined linearly between blocks."""

    def fit(self, margin: np.ndarray, y: np.ndarray, prior: float = 0.5) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # rate, weight, sum of margins
        for m, t in zip(margin[order], y[order]):
            blocks.append([float(t), 1.0, float(m)])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                rate, weight, at = blocks.pop()
                last = blocks[-1]
                last[0] = (last[0] * last[1] + rate * weight) / (last[1] + weight)
                last[1] += weight
                last[2] += at
        if not blocks:
            blocks = [[prior, 1.0, 0.0]]
        self.at = np.array([b[2] / b[1] for b in blocks])
        self.rate = np.array([b[0] for b in blocks])
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.at, self.rate), 0.0, 1.0)
