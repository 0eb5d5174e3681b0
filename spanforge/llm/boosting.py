"""Gradient-boosted trees on binned features, for models of a few thousand rows."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting with trees of a fixed depth over quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        self.trees: list[list[tuple]] = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree, value = self._tree(b, p - y, p * (1 - p))
            self.trees.append(tree)
            f += value
        return self

    def _tree(self, b, g, h):
        """Nodes as (feature, bin, left, right) or (None, value, 0, 0), and what each row gets."""
        nodes: list[tuple] = []
        value = np.zeros(len(g))

        def grow(rows, depth):
            at = len(nodes)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            nodes.append((None, -self.rate * total_g / (total_h + self.l2), 0, 0))
            best = (1e-6, None, None)
            if depth and len(rows) >= 2 * self.least:
                gain0 = total_g**2 / (total_h + self.l2)
                for k, edges in enumerate(self.edges):
                    if not len(edges):
                        continue
                    n = len(edges) + 1
                    c = b[rows, k]
                    lg, lh, ln = (np.cumsum(np.bincount(c, w, n))[:-1] for w in (g[rows], h[rows], None))
                    gain = lg**2 / (lh + self.l2) + (total_g - lg) ** 2 / (total_h - lh + self.l2) - gain0
                    gain[(ln < self.least) | (len(rows) - ln < self.least)] = 0
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], k, j)
            _, k, j = best
            if k is None:
                value[rows] = nodes[at][1]
            else:
                left = b[rows, k] <= j
                nodes[at] = (k, j, grow(rows[left], depth - 1), grow(rows[~left], depth - 1))
            return at

        grow(np.arange(len(g)), self.depth)
        return nodes, value

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        f = np.full(len(x), self.base)
        for nodes in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                for node, (k, j, left, right) in enumerate(nodes):
                    if k is not None and (here := at == node).any():
                        at[here] = np.where(b[here, k] <= j, left, right)
            f += np.asarray([n[1] if n[0] is None else 0.0 for n in nodes])[at]
        return 1 / (1 + np.exp(-f))
