"""Small gradient-boosted trees in numpy, fitted on a bounded sample and scored in batches."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees as flat node arrays; a leaf points at itself. A row goes left if its value is <= threshold."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """The conditions (feature, is <=, threshold) on the way to every node but the roots."""
        found = {}
        stack = [(root, ()) for root in self.roots]
        while stack:
            node, way = stack.pop()
            if way:
                found[way] = None
            if self.left[node] != node:
                f, t = int(self.feature[node]), float(self.threshold[node])
                stack += [(self.left[node], (*way, (f, True, t))), (self.right[node], (*way, (f, False, t)))]
        return sorted(found)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Quantile thresholds of each feature; midpoints, so that near values fall on the same side elsewhere."""
    found = []
    for column in x.T:
        value = np.unique(column)
        middle = (value[1:] + value[:-1]) / 2
        if len(middle) > bins:
            q = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
            middle = np.array([(v + value[min(np.searchsorted(value, v, side="right"), len(value) - 1)]) / 2 for v in q])
        found.append(np.unique(middle))
    return found


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 20, ridge: float = 1.0, monotone: dict[int, int] | None = None) -> Forest:
    """Fits boosted trees to 0/1 labels by second-order histogram splits.

    monotone: by feature, +1 if the score may only rise with it, -1 if only fall. A split that breaks
    the order is not taken, and both sides stay on their side of the middle further down. An empty
    sample, or one with a single label, gives no trees.
    """
    monotone = monotone or {}
    n, k = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    columns: list[list] = [[], [], [], [], []]
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = edges_of(x, bins)
        width = max(len(e) for e in edges) + 1
        code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        cell = code + np.arange(k) * width
        valid = np.zeros((k, width), bool)
        for f, e in enumerate(edges):
            valid[f, : len(e)] = True
        sign = np.array([monotone.get(f, 0) for f in range(k)])[:, None]
        margin = np.full(n, base)
        for _ in range(trees):
            p = sigmoid(margin)
            g, h = y - p, p * (1 - p)
            roots.append(_grow(columns, np.arange(n), g, h, cell, code, edges, width, valid, sign, depth, least, ridge, rate, margin, -np.inf, np.inf))
    arrays = [np.array(c) for c in columns]
    feature, threshold, left, right, value = arrays
    return Forest(np.array(roots, np.int64), feature.astype(np.int64), threshold.astype(float), left.astype(np.int64), right.astype(np.int64), value.astype(float), base, depth)


def _grow(columns, rows, g, h, cell, code, edges, width, valid, sign, depth, least, ridge, rate, margin, low, high) -> int:
    """Adds a node for the rows, and those below it; values stay within low..high."""
    node = len(columns[0])
    value = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))
    for c, v in zip(columns, (0, np.inf, node, node, rate * value), strict=True):
        c.append(v)
    best = _best_split(rows, g, h, cell, width, valid, sign, least, ridge, low, high) if depth and len(rows) >= 2 * least else None
    if best is None:
        margin[rows] += rate * value
        return node
    f, b, vl, vr = best
    go = code[rows, f] <= b
    middle = (vl + vr) / 2
    s = sign[f, 0]
    bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(s)]
    columns[0][node], columns[1][node] = f, edges[f][b]
    rest = (g, h, cell, code, edges, width, valid, sign, depth - 1, least, ridge, rate, margin)
    columns[2][node] = _grow(columns, rows[go], *rest, *bounds[0])
    columns[3][node] = _grow(columns, rows[~go], *rest, *bounds[1])
    return node


def _best_split(rows, g, h, cell, width, valid, sign, least, ridge, low, high):
    k = cell.shape[1]
    at = cell[rows].ravel()
    total = lambda w: np.bincount(at, np.repeat(w, k), minlength=k * width).reshape(k, width).cumsum(1)
    gl, hl, nl = total(g[rows]), total(h[rows]), total(np.ones(len(rows)))
    gr, hr, nr = g[rows].sum() - gl, h[rows].sum() - hl, len(rows) - nl
    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
    score = lambda v, a, b: 2 * v * a - v * v * (b + ridge)
    whole = np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high)
    gain = score(vl, gl, hl) + score(vr, gr, hr) - score(whole, g[rows].sum(), h[rows].sum())
    ok = valid & (nl >= least) & (nr >= least) & ((vr - vl) * sign >= 0)
    gain = np.where(ok, gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (int(f), int(b), vl[f, b], vr[f, b]) if gain[f, b] > 1e-6 else None


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient steps on the mean logistic loss."""
    n, k = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    b, w = float(np.log(share / (1 - share))), np.zeros(k)
    if not n or not k or not 0 < y.sum() < n:
        return b, w
    full = np.hstack([np.ones((n, 1)), x])
    v = np.ones(k + 1)
    for _ in range(20):  # the largest curvature
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / np.linalg.norm(full @ v) ** 2
    now = np.concatenate(([b], w))
    ahead, t = now.copy(), 1.0
    for _ in range(rounds):
        new = ahead - step * (full.T @ (sigmoid(full @ ahead) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - now)
        now, t = new, t_new
    return float(now[0]), now[1:]
