"""The gap-weighted subsequence kernel on short byte strings, for many strings at once.

Two strings are alike by the subsequences of ``ORDER`` characters they share; each occurrence weighs
``DECAY`` to the length it spans, so inserted characters lower a match but don't break it. Values are
normalised: 1 for equal strings.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

ORDER = 3
DECAY = 0.6
WIDTH = 24


def matrix(units: list[bytes]) -> np.ndarray:
    """Strings of at most ``WIDTH`` bytes as rows, zeros behind their ends."""
    return np.array(units, dtype=f"S{WIDTH}").view(np.uint8).reshape(len(units), WIDTH) if units else np.zeros((0, WIDTH), np.uint8)


def _raw(u: np.ndarray, same) -> np.ndarray:
    """Kernel of each row with its partner; ``same(i)`` says where the partner equals the rows' i-th characters."""
    n, z = same(0).shape
    state = [np.ones((z + 1, n), np.float32)] + [np.zeros((z + 1, n), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(n, np.float32)
    d, dd = np.float32(DECAY), np.float32(DECAY * DECAY)
    for i in range(u.shape[1]):
        m = same(i).T * dd
        if not m.any():
            for k in range(1, ORDER):
                state[k] *= d
            continue
        total += (m * state[ORDER - 1][:-1]).sum(axis=0)
        for k in range(ORDER - 1, 0, -1):
            step = m * state[k - 1][:-1]
            for j in range(1, z):
                step[j] += d * step[j - 1]
            state[k] *= d
            state[k][1:] += step
    return total


def self_kernel(u: np.ndarray) -> np.ndarray:
    """Kernel of each row with itself."""
    return np.concatenate([_raw(p, lambda i, p=p: (p == p[:, i : i + 1]) & (p > 0)) for p in _parts(u)]) if len(u) else np.zeros(0, np.float32)


def _parts(u: np.ndarray):
    """Rows in blocks, each cut to its longest string."""
    order = range(0, len(u), 4096)
    for i in order:
        p = u[i : i + 4096]
        yield p[:, : max(1, int((p > 0).sum(axis=1).max()))]


@lru_cache(maxsize=None)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All index triples of a string of ``n`` characters, and their weights."""
    i, j, k = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


class Landmarks:
    """Landmarks as an inverted index from subsequence to weights, one column a landmark, each column of norm 1."""

    def __init__(self, landmarks: list[bytes]):
        rows = matrix(landmarks)
        self.code = np.zeros(256, np.int64)
        letters = np.unique(rows[rows > 0])
        self.code[letters] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        found: dict[int, dict[int, float]] = {}
        for m, mark in enumerate(landmarks):
            if len(mark) < ORDER:
                continue
            i, j, k, w = _triples(len(mark))
            c = self.code[rows[m]]
            for key, weight in zip(((c[i] * self.base + c[j]) * self.base + c[k]).tolist(), w.tolist(), strict=True):
                column = found.setdefault(key, {})
                column[m] = column.get(m, 0.0) + weight
        self.number = np.full(self.base**ORDER, -1, np.int32)
        self.weights = np.zeros((len(found), len(landmarks)), np.float32)
        for f, (key, columns) in enumerate(found.items()):
            self.number[key] = f
            for m, weight in columns.items():
                self.weights[f, m] = weight
        norm = np.sqrt((self.weights**2).sum(axis=0))
        self.weights /= np.where(norm > 0, norm, 1)

    def values(self, u: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Normalised kernel of each row with each landmark."""
        out = np.zeros((len(u), self.weights.shape[1]), np.float32)
        size = (u > 0).sum(axis=1)
        for n in np.unique(size[size >= ORDER]).tolist():
            i, j, k, w = _triples(n)
            rows = np.flatnonzero(size == n)
            n_features = len(self.weights)
            step = max(1, min(1_000_000 // max(n_features, 1), 200_000 // len(w)))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                c = self.code[u[part, :n]]
                f = self.number[(c[:, i] * self.base + c[:, j]) * self.base + c[:, k]]
                r, t = np.nonzero(f >= 0)
                if len(r):
                    dense = np.bincount(r * n_features + f[r, t], w[t], len(part) * n_features)
                    out[part] = dense.reshape(len(part), n_features).astype(np.float32) @ self.weights
        # Strings that share nothing with any landmark need no norm.
        some = np.flatnonzero(out.any(axis=1))
        scale = np.sqrt(self_kernel(u[some]) if own is None else own[some])[:, None]
        out[some] = np.divide(out[some], scale, out=np.zeros_like(out[some]), where=scale > 0)
        return out


def kernel(u: np.ndarray, landmarks: list[bytes], own: np.ndarray | None = None) -> np.ndarray:
    """Normalised kernel of each row with each landmark; strings shorter than ``ORDER`` are like nothing."""
    return Landmarks(landmarks).values(u, own)
