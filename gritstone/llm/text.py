"""Vectorised text kernels over Arrow string buffers.

Everything here works on the bytes of a whole slice of documents at once, so the cost of Python is paid
per slice. A *word* is a maximal run of ASCII letters, digits and bytes above 127, after lower-casing;
a *line* is what lies between line feeds. Hashes are 64-bit polynomial hashes, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_SEGMENT = 1 << 16
_MASK = (1 << 64) - 1

_rng = np.random.default_rng(961_748_941)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASES = {"byte": 0x9E3779B97F4A7C15, "lane0": 0xD6E8FEB86659FD93, "lane1": 0xA0761D6478BD642F}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _power_tables(base: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n of each at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        tables = []
        for b in (_BASES[base], pow(_BASES[base], -1, 1 << 64)):
            t = np.full(size, b & _MASK, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        have = _powers[base] = (tables[0], tables[1])
    return have


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``limit`` bytes of ``column`` each; a longer row is its own slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def _lower_same_length(text: str) -> str:
    return "".join(low if len((low := c.lower()).encode()) == len(c.encode()) else c for c in text)


def lowered(column: pa.Array) -> pa.Array:
    """Lower case, every row as many bytes long as before, so that offsets hold for the original too."""
    if column.null_count:
        column = pc.fill_null(column, "")
    low = pc.utf8_lower(column)
    same = pc.equal(pc.binary_length(low), pc.binary_length(column))
    if not pc.all(same, min_count=0).as_py():
        rows = [b if ok else _lower_same_length(a) for a, b, ok in zip(column.to_pylist(), low.to_pylist(), same.to_pylist(), strict=True)]
        low = pa.array(rows, column.type)
    return low


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and don't overlap. Memory stays bounded for long buffers."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _SEGMENT, "right")))
        lo, hi = int(start[at]), int(end[to - 1])
        power, inverse = _power_tables("byte", hi - lo + 1)
        x = _LETTER[buf[lo:hi]]
        x *= power[: hi - lo]
        p = np.empty(hi - lo + 1, np.uint64)
        p[0] = 0
        np.cumsum(x, out=p[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = (p[e] - p[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


class Words(NamedTuple):
    """Words of a slice: byte spans, hashes, and the index of the first word of each row (one more than rows)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words; a word never reaches over the end of a row."""
    inside = _IS_WORD[buf]
    held = off[:-1] < off[1:]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    a, z = off[:-1][held], off[1:][held] - 1
    opens[a], closes[z] = inside[a], inside[z]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def words(buf: np.ndarray, off: np.ndarray) -> Words:
    """Words of lower-cased rows."""
    start, end = word_spans(buf, off)
    return Words(start, end, span_hashes(buf, start, end), np.searchsorted(start, off))


class Lines(NamedTuple):
    """Lines of a slice: byte spans without the line feed, row, number of words, two 64-bit digests of the words."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    n_words: np.ndarray
    lane0: np.ndarray
    lane1: np.ndarray


def sequence_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: str) -> np.ndarray:
    """A 64-bit hash of each run ``values[start:end]``."""
    power, inverse = _power_tables(base, len(values) + 1)
    p = np.empty(len(values) + 1, np.uint64)
    p[0] = 0
    np.cumsum(values * power[: len(values)], out=p[1:])
    return mix((p[end] - p[start]) * inverse[start] + (end - start).astype(np.uint64))


def lines(buf: np.ndarray, off: np.ndarray) -> Lines:
    """Lines of lower-cased rows; two lines with the same words have the same digests. Empty rows have no line."""
    feeds = np.flatnonzero(buf == 10)
    held = off[:-1] < off[1:]
    end = np.sort(np.concatenate([feeds, off[1:][held]]), kind="stable")
    # A line feed that is a row's last byte opens one more, empty line, as splitting the text would.
    row = np.searchsorted(off[1:], end, "left")
    feed = np.zeros(len(end), bool)
    feed[np.searchsorted(end, feeds, "right") - 1] = True
    ends_at_border = ~feed
    row[feed] = np.searchsorted(off[1:], end[feed], "right")
    start = np.empty(len(end), np.int64)
    if len(end):
        start[0] = 0
        start[1:] = end[:-1] + ~ends_at_border[:-1]
    start = np.maximum(start, off[row]) if len(end) else start
    ws, we = word_spans(buf, off)
    h = span_hashes(buf, ws, we)
    a, z = np.searchsorted(ws, start), np.searchsorted(ws, end)
    return Lines(start, end, row, z - a, sequence_hash(h, a, z, "lane0"), sequence_hash(mix(h), a, z, "lane1"))


def char_offsets(buf: np.ndarray, off: np.ndarray, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Character offsets within their rows of byte positions ``pos``."""
    later = np.concatenate([[0], np.cumsum((buf & 0xC0) == 0x80)])
    return (pos - off[row]) - (later[pos] - later[off[row]])


def runs(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i]``, all in one array."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
