"""Gradient-boosted trees for two classes, in numpy: histogram splits, logistic loss, calibrated scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 32
    least: int = 4
    l2: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        self.nodes = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree, leaf = self._tree(b, g, h)
            self.nodes.append(tree)
            f += tree[2][leaf]
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        size = 1 << (self.depth + 1)
        feat, cut, value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        at = np.ones(len(b), dtype=np.int64)
        width = self.bins + 1
        for level in range(self.depth + 1):
            first, count = 1 << level, 1 << level
            local = at - first
            here = local >= 0  # rows whose node was not split stay behind
            slot, gh, hh = local[here], g[here], h[here]
            gs, hs, ns = (np.bincount(slot, w, count) for w in (gh, hh, None))
            live = ns > 0
            value[first : 2 * first][live] = self.rate * gs[live] / (hs[live] + self.l2)
            if level == self.depth:
                break
            best, pick, where = np.full(count, 1e-6), np.full(count, -1), np.zeros(count, dtype=np.int64)
            for j in range(b.shape[1]):
                key = slot * width + b[here, j]
                gl, hl, nl = (np.cumsum(np.bincount(key, w, count * width).reshape(count, width), axis=1)[:, :-1] for w in (gh, hh, None))
                gain = gl**2 / (hl + self.l2) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + self.l2) - (gs**2 / (hs + self.l2))[:, None]
                gain[(nl < self.least) | (ns[:, None] - nl < self.least)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(count), k]
                better = top > best
                best[better], pick[better], where[better] = top[better], j, k[better]
            feat[first : 2 * first], cut[first : 2 * first] = pick, where
            rows = np.nonzero(here)[0]
            go = pick[slot] >= 0
            rows, slot = rows[go], slot[go]
            at[rows] = at[rows] * 2 + (b[rows, pick[slot]] > where[slot])
        return (feat, cut, value), at

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        f = np.full(len(x), self.base)
        for feat, cut, value in self.nodes:
            at = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                j = feat[at]
                go = j >= 0
                at = np.where(go, at * 2 + (b[np.arange(len(x)), np.maximum(j, 0)] > cut[at]), at)
            f += value[at]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray, beta: float = 1.0) -> Boosted:
        """Fits a logistic curve to held-out scores, then takes the threshold of best F score on them; ``beta`` weighs recall against precision."""
        s = self.raw(x)
        a, c = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * s + c, -40, 40)))
            w = np.maximum(p * (1 - p), 1e-6)
            grad = np.array([((y - p) * s).sum() - 0.01 * (a - 1), (y - p).sum() - 0.01 * c])
            hess = np.array([[(w * s * s).sum() + 0.01, (w * s).sum()], [(w * s).sum(), w.sum() + 0.01]])
            step = np.linalg.solve(hess, grad)
            a, c = a + step[0], c + step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.scale = (float(max(a, 0.05)), float(c))
        p = self.score(x)
        grid = np.linspace(0.05, 0.95, 91)
        b2 = beta * beta
        score = [(1 + b2) * ((p >= t) & (y == 1)).sum() / max(1, (p >= t).sum() + b2 * (y == 1).sum()) for t in grid]
        top = np.nonzero(np.array(score) >= max(score) - 1e-12)[0]
        self.threshold = float(grid[top[len(top) // 2]])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.raw(x) + self.scale[1], -40, 40))) if len(x) else np.zeros(0)
