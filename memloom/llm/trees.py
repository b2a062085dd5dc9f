"""Histogram gradient-boosted trees for two classes, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in one set of arrays; a leaf is its own child."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: all rows go down all trees at once."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def constant(p: float) -> Forest:
    zero = np.zeros(1, np.int64)
    p = min(max(p, 1e-3), 1 - 1e-3)
    return Forest(zero, np.zeros(1), zero, zero, np.zeros(1), zero, float(np.log(p / (1 - p))), 0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 3.0) -> Forest:
    """Boost the logistic loss; split points come from histograms over ``bins`` quantile bins of each feature."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    cell = binned + np.arange(width) * bins
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, base)
    nodes: list[list[float]] = []  # feature, limit, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        first = len(nodes)
        roots.append(first)
        nodes.append([0, 0.0, first, first, -rate * g.sum() / (h.sum() + l2)])
        at = np.full(n, first)
        level = [first]
        for _ in range(depth):
            place = {v: i for i, v in enumerate(level)}
            live = np.flatnonzero(np.isin(at, level))
            if not len(live):
                break
            slot = np.array([place[v] for v in at[live]])
            key = (slot[:, None] * (width * bins) + cell[live]).ravel()
            shape = (len(level), width, bins)
            hg = np.bincount(key, np.repeat(g[live], width), len(level) * width * bins).reshape(shape).cumsum(axis=2)
            hh = np.bincount(key, np.repeat(h[live], width), len(level) * width * bins).reshape(shape).cumsum(axis=2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
            gain[(hh < least) | (th - hh < least)] = -1
            after = []
            for i, v in enumerate(level):
                f, b = np.unravel_index(np.argmax(gain[i]), shape[1:])
                if gain[i, f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                left, right = len(nodes), len(nodes) + 1
                gl, hl = hg[i, f, b], hh[i, f, b]
                nodes.append([0, 0.0, left, left, -rate * gl / (hl + l2)])
                nodes.append([0, 0.0, right, right, -rate * (tg[i, f, 0] - gl) / (th[i, f, 0] - hl + l2)])
                nodes[v] = [f, edges[f][b], left, right, 0.0]
                own = at == v
                at = np.where(own, np.where(binned[:, f] <= b, left, right), at)
                after += [left, right]
            level = after
            if not level:
                break
        raw += np.array([r[4] for r in nodes])[at]
    a = np.array(nodes, dtype=np.float64)
    return Forest(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots), base, depth)
