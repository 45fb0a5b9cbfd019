"""A generalised additive model with pairwise interactions, fitted by cyclic gradient boosting.

Features are cut into quantile bins. Boosting visits one feature after another, again and again; each
visit fits a tree of at most four leaves on that feature alone to the log-loss gradients and adds it to the
feature's lookup table. Then the pairs with most left to explain get tables of their own in the same
way, with trees that split on either feature. A score is the intercept plus one table cell a term.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np

BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 32, 8, 120, 60, 6, 0.15, 2.0


class Gam(NamedTuple):
    """Bin edges and tables. ``pairs`` holds (feature, feature); pair tables use the coarser edges."""

    names: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    coarse: tuple[np.ndarray, ...]
    intercept: float
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_tables: tuple[np.ndarray, ...]
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of features."""
        out = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, j], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        return _sigmoid(self.score(x))


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of neighbouring bins."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    rg, rh = g.sum() - lg, h.sum() - lh
    gain = lg**2 / (lh + RIDGE) + rg**2 / (rh + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a tree on one feature."""
    gain, cut = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by cell: one cut on a feature, then one on the other feature in each half."""
    best, found = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        gain, cut = _best_cut(a.sum(axis=1), b.sum(axis=1))
        halves = [(slice(0, cut), slice(cut, None)), (slice(0, None),)][cut == 0]
        out, total = np.zeros_like(a), gain
        for half in halves:
            more, at = _best_cut(a[half].sum(axis=0), b[half].sum(axis=0))
            total += more
            for part in (slice(0, at), slice(at, None)) if at else (slice(0, None),):
                out[half, part] = -a[half, part].sum() / (b[half, part].sum() + RIDGE)
        if total > best:
            best, found = total, out if axis == 0 else out.T
    return found


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], keep_share: float = 0.999, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Gam:
    """Fit to rows ``x`` with labels ``y`` of 0 and 1.

    A fifth of the rows is held out to set ``threshold``: the highest one, at most one half, that keeps
    ``keep_share`` of the positive rows held out. With one class only, or no rows, the model is constant.
    """
    n_features = len(names)
    if not len(x) or y.min() == y.max():
        flat = tuple(np.zeros(1) for _ in names)
        none = tuple(np.zeros(0) for _ in names)
        return Gam(names, none, none, 30.0 if not len(x) or y[0] else -30.0, flat, (), (), 0.5)
    held = np.arange(len(x)) % 5 == 4
    if y[~held].min() == y[~held].max():
        held[:] = False
    tx, ty = x[~held], y[~held].astype(float)
    edges = tuple(_edges(tx[:, j], BINS) for j in range(n_features))
    coarse = tuple(_edges(tx[:, j], PAIR_BINS) for j in range(n_features))
    binned = [np.searchsorted(edges[j], tx[:, j], "right") for j in range(n_features)]
    rough = [np.searchsorted(coarse[j], tx[:, j], "right") for j in range(n_features)]
    base = float(np.log(ty.mean() / (1 - ty.mean())))
    score = np.full(len(tx), base)
    tables = [np.zeros(len(e) + 1) for e in edges]
    for _ in range(rounds):
        for j in range(n_features):
            p = _sigmoid(score)
            size = len(tables[j])
            step = RATE * _tree(np.bincount(binned[j], p - ty, size), np.bincount(binned[j], p * (1 - p), size))
            tables[j] += step
            score += step[binned[j]]
    p = _sigmoid(score)
    gains = []
    cells, shapes = {}, {}
    for i, j in combinations(range(n_features), 2):
        shapes[i, j] = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cells[i, j] = rough[i] * shapes[i, j][1] + rough[j]
        size = shapes[i, j][0] * shapes[i, j][1]
        g, h = np.bincount(cells[i, j], p - ty, size), np.bincount(cells[i, j], p * (1 - p), size)
        gains.append((float((g**2 / (h + RIDGE)).sum()), (i, j)))
    chosen = tuple(pair for _, pair in sorted(gains, reverse=True)[:pairs])
    pair_tables = [np.zeros(shapes[c]) for c in chosen]
    for _ in range(pair_rounds):
        for k, c in enumerate(chosen):
            p = _sigmoid(score)
            size = shapes[c][0] * shapes[c][1]
            step = RATE * _pair_tree(np.bincount(cells[c], p - ty, size).reshape(shapes[c]), np.bincount(cells[c], p * (1 - p), size).reshape(shapes[c]))
            pair_tables[k] += step
            score += step.ravel()[cells[c]]
    model = Gam(names, edges, coarse, base, tuple(tables), chosen, tuple(pair_tables), 0.5)
    good = model.probability(x[held & (y == 1)]) if held.any() else np.zeros(0)
    return model._replace(threshold=float(min(0.5, np.quantile(good, 1 - keep_share)))) if len(good) else model
