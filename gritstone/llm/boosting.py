"""Gradient-boosted trees on binned features for a yes-or-no label, with a calibration of their scores."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 48, 80, 4, 0.2, 1.0, 8


class Boosted(NamedTuple):
    """Trees as arrays by level order: feature (-1: leaf), bin to go right from, leaf value; isotonic calibration."""

    edges: tuple[np.ndarray, ...]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    points: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds before calibration."""
        binned = np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = f[at] >= 0
                right = binned[rows, np.maximum(f[at], 0)] >= c[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += v[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability."""
        return np.interp(self.score(x), self.points, self.levels)


def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, n_features = 2 ** (DEPTH + 1) - 1, binned.shape[1]
    at = np.arange(n_features) * width
    feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
    rows = {0: np.arange(len(g))}
    for node in range(size):
        own = rows.pop(node, None)
        if own is None:
            continue
        tg, th = g[own].sum(), h[own].sum()
        value[node] = -RATE * tg / (th + RIDGE)
        if node >= 2**DEPTH - 1 or len(own) < 2 * LEAST:
            continue
        # All features' histograms at once, one row each.
        flat = (binned[own] + at).ravel()
        lg, lh, ln = (np.cumsum(np.bincount(flat, w if w is None else np.repeat(w[own], n_features), n_features * width).reshape(n_features, width), axis=1)[:, :-1] for w in (g, h, None))
        gain = lg**2 / (lh + RIDGE) + (tg - lg) ** 2 / (th - lh + RIDGE) - tg**2 / (th + RIDGE)
        gain[(ln < LEAST) | (len(own) - ln < LEAST)] = 0
        j, k = divmod(int(gain.argmax()), width - 1)
        if gain[j, k] > 1e-6:
            feature[node], cut[node] = j, k + 1
        if feature[node] >= 0:
            right = binned[own, feature[node]] >= cut[node]
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return feature, cut, value


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and levels of the rising step function nearest to the labels, by pooling neighbours."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], last[2]]
    # Half a count of either kind, so that nothing is ever certain.
    return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    """Fit to four fifths of the rows, calibrate on the rest."""
    held = np.arange(len(x)) % 5 == 4
    tx, ty = x[~held], y[~held].astype(float)
    edges = tuple(np.unique(np.quantile(tx[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1]))
    binned = np.column_stack([np.searchsorted(e, tx[:, j], "right") for j, e in enumerate(edges)])
    width = max(2, *(len(e) + 1 for e in edges))
    base = float(np.log(ty.mean() / (1 - ty.mean())))
    s, grown = np.full(len(tx), base), []
    rows = np.arange(len(tx))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-s))
        tree = _grow(binned, p - ty, p * (1 - p), width)
        grown.append(tree)
        at = np.zeros(len(tx), np.int64)
        for _ in range(DEPTH):
            inner = tree[0][at] >= 0
            at = np.where(inner, 2 * at + 1 + (binned[rows, np.maximum(tree[0][at], 0)] >= tree[1][at]), at)
        s += tree[2][at]
    model = Boosted(edges, *(np.array([t[k] for t in grown]) for k in range(3)), base, np.zeros(1), np.zeros(1))
    points, levels = isotonic(model.score(x[held]), y[held])
    return model._replace(points=points, levels=levels)
