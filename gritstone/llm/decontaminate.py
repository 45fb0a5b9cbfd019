"""Benchmark decontamination with spaced seeds.

Fixed masks say which positions of a token window count. Windows of benchmark items and of documents are
hashed under every mask, so a window still matches where tokens at ignored positions were replaced.
Document windows are looked up in the sorted benchmark hashes, behind a bitmap. Around each hit the item
is laid along the document and compared token by token: a stretch of ``window`` tokens (or the whole item, if
shorter) overlaps where ``min_match`` of its tokens agree at least. Stretches that touch are one overlap; those apart are
several. Where an item can be laid along a place in several ways, the one that agrees in most tokens is reported.

The benchmark's hashes go to the workers as one broadcast, and their size is checked first: beyond
``pass_bytes`` of benchmark text the items are split, and each part is one more pass over the documents.
Documents are read once a pass and nothing of them is shuffled.

Defined results for odd input: tokens are lower-cased words, so case, punctuation and spacing don't
matter. Null and empty texts and items overlap with nothing, and so do items of fewer tokens than the
lightest mask has. Equal items are reported one by one, repeated rows too; null ids are carried as null.
An empty table on either side gives no overlap. Filtering keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map
from .text import Words, char_offsets, lowered, runs, slices, text_buffer, words

#: Of any twelve tokens of which nine agree, wherever the three others are, one of these masks sees a stretch that agrees.
MASKS = ("11111", "110111", "101000111", "101001011")
WINDOW = 12
MIN_MATCH = 0.75
PASS_BYTES = 64 << 20
_CHUNK = 1 << 18
_FACTOR = np.random.default_rng(7_368_787).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Seeds(NamedTuple):
    """Hashes of the benchmark's windows in order, with item and position; tokens of the items; bitmap of the hashes."""

    hash: np.ndarray
    item: np.ndarray
    at: np.ndarray
    token: np.ndarray
    first: np.ndarray
    ids: pa.Array
    bitmap: np.ndarray
    shift: int
    masks: tuple[str, ...]
    window: int
    min_match: float


def _windows(w: Words, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first token of each window that lies within its row, and the window's hash."""
    span, n = len(mask), len(w.hash)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n - span + 1, _FACTOR[63 - number], np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h += w.hash[k : n - span + 1 + k] * _FACTOR[k]
    size = np.diff(w.first)
    left = np.repeat(w.first[1:], size)[: len(h)] - np.arange(len(h))
    return np.flatnonzero(left >= span), h


def make_seeds(ids: pa.Array, texts: pa.Array, masks: tuple[str, ...] = MASKS, window: int = WINDOW, min_match: float = MIN_MATCH) -> Seeds:
    """Seeds of benchmark items."""
    w = words(*text_buffer(lowered(texts)))
    row = w.row
    parts = []
    for number, mask in enumerate(masks):
        at, h = _windows(w, mask, number)
        parts.append((h[at], row[at], at - w.first[row[at]]))
    h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    bits = min(28, max(16, int(len(h) * 16 or 1).bit_length()))
    bitmap = np.zeros(1 << bits, bool)
    bitmap[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
    return Seeds(h[order], item[order], at[order], w.hash, w.first, ids, bitmap, 64 - bits, masks, window, min_match)


def _hits(seeds: Seeds, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token of the document, first seed and number of seeds for each window that the benchmark has."""
    found = []
    for number, mask in enumerate(seeds.masks):
        at, h = _windows(w, mask, number)
        at = at[seeds.bitmap[(h[at] >> np.uint64(seeds.shift)).astype(np.int64)]]
        lo = np.searchsorted(seeds.hash, h[at], "left")
        n = np.searchsorted(seeds.hash, h[at], "right") - lo
        found.append(np.stack([at, lo, n])[:, n > 0])
    found = np.concatenate(found, axis=1)
    return tuple(found[:, np.argsort(found[0], kind="stable")])


def _candidates(seeds: Seeds, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, item and offset of the item's first token against the row's, a bounded number at a time.

    One of each is given, or a few more where a seed has more items than that bound.
    """
    at, lo, n = _hits(seeds, w)
    row = np.searchsorted(w.first, at, "right") - 1
    total = np.cumsum(n)
    begin = 0
    while begin < (total[-1] if len(total) else 0):
        end = min(begin + _CHUNK, int(total[-1]))
        i, j = np.searchsorted(total, begin, "right"), np.searchsorted(total, end, "left") + 1
        first = np.maximum(begin - (total[i:j] - n[i:j]), 0)
        size = np.minimum(total[i:j], end) - (total[i:j] - n[i:j]) - first
        which, of = runs(size, lo[i:j] + first), np.repeat(np.arange(i, j), size)
        yield tuple(np.unique(np.stack([row[of], seeds.item[which], at[of] - w.first[row[of]] - seeds.at[which]]), axis=1))
        begin = end


def _verified(seeds: Seeds, w: Words, row: np.ndarray, item: np.ndarray, diff: np.ndarray) -> dict[str, np.ndarray]:
    """Of the candidates, those with an overlap: which one, tokens that agree, first and last token of it."""
    n = np.diff(seeds.first)[item]
    begin = np.cumsum(n) - n
    inner = runs(n, np.zeros(len(n), np.int64))
    of = np.repeat(np.arange(len(n)), n)
    there = inner + diff[of]
    inside = (there >= 0) & (there < np.diff(w.first)[row][of])
    same = np.zeros(len(of), bool)
    same[inside] = seeds.token[seeds.first[item[of[inside]]] + inner[inside]] == w.hash[w.first[row[of[inside]]] + there[inside]]
    total = np.concatenate([[0], np.cumsum(same)])
    whole = np.concatenate([[0], np.cumsum(inside)])
    size = np.minimum(seeds.window, n)
    starts = inner <= n[of] - size[of]
    a = np.flatnonzero(starts)
    z = a + size[of[a]]
    need = np.ceil(seeds.min_match * size - 1e-9).astype(np.int64)
    # A window must lie within the row altogether.
    good = (total[z] - total[a] >= need[of[a]]) & (whole[z] - whole[a] == size[of[a]])
    a, z = a[good], z[good]
    owner = of[a]
    # Windows that overlap or touch are one stretch.
    new = np.ones(len(a), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (a[1:] > z[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1 if len(a) else first
    which, lo, hi = owner[first], a[first], z[last]
    return {"which": which, "agree": total[hi] - total[lo], "lo": lo - begin[which] + diff[which], "hi": hi - begin[which] + diff[which]}


def _best(r: np.ndarray, i: np.ndarray, agree: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of the stretches of each row and item, those that agree in most tokens; none overlaps a better one."""
    order = np.lexsort((lo, hi - lo, -agree, i, r))
    same = np.zeros(len(order), bool)
    same[1:] = (r[order][1:] == r[order][:-1]) & (i[order][1:] == i[order][:-1])
    kept = ~same
    # Most rows have one stretch of an item; the others are looked at one by one.
    taken: list[tuple[int, int]] = []
    for k in np.flatnonzero(same):
        if not same[k - 1]:
            taken = [(lo[order[k - 1]], hi[order[k - 1]])]
        b, e = lo[order[k]], hi[order[k]]
        if all(e <= x or y <= b for x, y in taken):
            taken.append((b, e))
            kept[k] = True
    return order[kept]


def overlaps(seeds: Seeds, column: pa.Array) -> dict[str, np.ndarray]:
    """The overlaps of each row and item that have any: row, item, tokens that agree, length, character offsets."""
    buf, off = text_buffer(lowered(column))
    w = words(buf, off)
    parts = [np.zeros((5, 0), np.int64)]
    for row, item, diff in _candidates(seeds, w):
        sizes = np.cumsum(np.diff(seeds.first)[item])
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _CHUNK, "right")))
            v = _verified(seeds, w, row[at:to], item[at:to], diff[at:to])
            parts.append(np.stack([row[at:to][v["which"]], item[at:to][v["which"]], v["agree"], v["lo"], v["hi"]]))
            at = to
    r, i, agree, lo, hi = np.concatenate(parts, axis=1)
    best = _best(r, i, agree, lo, hi)
    r, i, agree, lo, hi = (x[best] for x in (r, i, agree, lo, hi))
    begin, end = w.start[w.first[r] + lo], w.end[w.first[r] + hi - 1]
    return {"row": r, "item": i, "agree": agree, "length": hi - lo, "begin": char_offsets(buf, off, r, begin), "end": char_offsets(buf, off, r, end)}


def _passes(benchmark: DataFrame, pass_bytes: int, **settings) -> Iterator[Seeds]:
    """Seeds of the whole benchmark, or of one part after another if it is large."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / pass_bytes))
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        t = own.toArrow().combine_chunks()
        ids, texts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t.column("item_id"), t.column("text")))
        yield make_seeds(ids, texts, **settings)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, min_match: float = MIN_MATCH, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row for each overlap of a document and a benchmark item; two places of one item are two rows.

    Columns: ``doc_id``, ``item_id``, ``n_agree`` (equal tokens), ``n_tokens`` (length of the overlap),
    ``begin`` and ``end`` (its character offsets in the document).
    """
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", kind), *(T.StructField(c, T.IntegerType()) for c in ("n_agree", "n_tokens", "begin", "end"))])
    parts = []
    for seeds in _passes(benchmark, pass_bytes, masks=masks, window=window, min_match=min_match):
        held = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                o = overlaps(held.value, batch.column("text"))
                columns = [batch.column("doc_id").take(pa.array(o["row"])), held.value.ids.take(pa.array(o["item"])), *(pa.array(o[c], pa.int32()) for c in ("agree", "length", "begin", "end"))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_agree", "n_tokens", "begin", "end"])

        parts.append(arrow_map(docs.select("doc_id", "text"), run, schema))
    return reduce(DataFrame.union, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, min_match: float = MIN_MATCH, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents that overlap with no benchmark item, all columns as they were."""
    spark = docs.sparkSession
    for seeds in _passes(benchmark, pass_bytes, masks=masks, window=window, min_match=min_match):
        held = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                keep = np.ones(batch.num_rows, bool)
                keep[overlaps(held.value, batch.column("text"))["row"]] = False
                yield batch.filter(pa.array(keep))

        docs = arrow_map(docs, run, docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap between documents and benchmark items."""
    return find_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
