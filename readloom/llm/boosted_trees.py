"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, and flat node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Forest:
    """All trees' nodes in arrays; a leaf leads to itself, so that every row takes `depth` steps in each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(x):
            return np.zeros(0)
        at = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return sigmoid(self.start + self.value[at].sum(1))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, least: int = 10, ridge: float = 1.0, bins: int = 64) -> Forest:
    """Boost trees on the logistic loss. monotone: for each feature -1 (never rises), 0 (free) or 1 (never falls).

    A split that breaks a constraint is not taken, and children's values are bounded by the middle of theirs, so that the
    constraint holds between all leaves. With no rows, or labels of one kind, the forest is a constant.
    """
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        margin = np.full(len(y), start)
        for _ in range(trees):
            p = sigmoid(margin)
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            roots.append(_grow(nodes, binned, edges, g, h, np.arange(len(y)), monotone, depth, rate, least, ridge, bins, -np.inf, np.inf, margin))
    if not nodes:
        nodes, roots = [[0, 0.0, 0, 0, 0.0]], [0]
    a = np.array(nodes, dtype=float)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), start, depth)


def _grow(nodes, binned, edges, g, h, rows, monotone, depth, rate, least, ridge, bins, low, high, margin) -> int:
    here = len(nodes)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    value = float(np.clip(-total_g / (total_h + ridge), low, high))
    nodes.append([0, 0.0, here, here, value * rate])
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            gl = np.bincount(b, g[rows], bins + 1).cumsum()[:-1]
            hl = np.bincount(b, h[rows], bins + 1).cumsum()[:-1]
            n = np.bincount(b, minlength=bins + 1).cumsum()[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            loss = lambda v, gg, hh: -(gg * v + 0.5 * (hh + ridge) * v * v)
            gain = loss(vl, gl, hl) + loss(vr, gr, hr) - loss(value, total_g, total_h)
            gain[(n < least) | (len(rows) - n < least) | (monotone[f] * (vr - vl) < 0)] = -1
            gain[len(edges[f]) :] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, vl[k], vr[k]))
    if best[1] is None:
        margin[rows] += value * rate
        return here
    f, k, vl, vr = best[1]
    goes = binned[rows, f] <= k
    middle = (vl + vr) / 2
    bounds = ((low, high), (low, high))
    if monotone[f]:
        bounds = ((low, middle), (middle, high)) if monotone[f] > 0 else ((middle, high), (low, middle))
    children = [_grow(nodes, binned, edges, g, h, r, monotone, depth - 1, rate, least, ridge, bins, *b, margin) for r, b in zip((rows[goes], rows[~goes]), bounds)]
    nodes[here] = [f, float(edges[f][k]), *children, 0.0]
    return here
