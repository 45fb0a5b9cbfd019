"""A minimal perfect hash over 64-bit keys, built and probed with numpy.

Keys fall into a bit array; keys that fall alone stay, the others go on to the next, smaller level. A
key's number is the rank of its bit. Around 3.7 bits a key at the default ``gamma``.
"""

from __future__ import annotations

import numpy as np

from .text import mix

_LEVELS = 48


def _bits(key: np.ndarray, level: int, size: int) -> np.ndarray:
    h = mix(key + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & ((1 << 64) - 1)))
    return ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def build(keys: np.ndarray, gamma: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """``(sizes, words)``: the bit sizes of the levels, and all levels' bits. ``keys`` must be distinct."""
    sizes, levels, left = [], [], keys
    while len(left):
        if len(sizes) == _LEVELS:
            raise ValueError("keys are not distinct")
        size = max(64, -(-int(len(left) * gamma) // 64) * 64)
        at = _bits(left, len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        left = left[~alone[at]]
    words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
    return np.array(sizes, np.int64), words


def ranks(words: np.ndarray) -> np.ndarray:
    """The number of set bits before each word."""
    return np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.uint32) if len(words) else np.zeros(0, np.uint32)


def lookup(sizes: np.ndarray, words: np.ndarray, rank: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The number of each key, below the count of keys; any number or -1 for a key that was not among those built."""
    slot = np.full(len(keys), -1, np.int64)
    open_, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        if not len(open_):
            break
        bit = _bits(keys[open_], level, size).astype(np.int64) + base
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        value = words[word]
        hit = (value >> shift) & np.uint64(1) == 1
        below = value & ((np.uint64(1) << shift) - np.uint64(1))
        found = rank[word].astype(np.int64) + np.bitwise_count(below)
        slot[open_[hit]] = found[hit]
        open_ = open_[~hit]
        base += size
    return slot
