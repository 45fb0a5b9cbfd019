"""Line dedup: documents probe minimal perfect hash shards of the repeated lines; no line is ever joined.

1. Every task reduces its documents' lines to digests with a count and the lowest ``doc_id``; one shuffle
   of those few bytes adds them up. Lines counted fewer than ``min_count`` times need no entry: an
   absent line and a rare one are treated alike.
2. Each shard of the digest space becomes a minimal perfect hash with three flat arrays: a 64-bit
   fingerprint, the count and the owner (the lowest ``doc_id``). A shard is one file in the shared folder. Slot and fingerprint
   come from two independent hashes, so of 10**12 lines fewer than one is expected to be taken for one that it isn't.
3. Documents are read again. Every line looks its slot up, compares the fingerprint and reads count and
   owner. Shards are memory-mapped, so the index may be larger than a worker's memory; the lines of many slices are
   probed together, shard by shard, so that a shard is fetched once for all of them.

Decision: a line counted ``min_count`` times or more, and of ``min_words`` words or more, stays in the
document with the lowest ``doc_id``, there at its first position, and goes everywhere else.

Defined results for odd input: lines with the same words in the same order are the same line, whatever
their case and punctuation. A null text stays null, an empty one empty. Lines below ``min_words`` words
(blank ones too) stay. Rows with the same ``doc_id`` are the same document: each keeps its copy. A null
``doc_id`` ranks after all others, and all rows with it count as one document; one that is no integer is refused.
An empty table gives an empty table. Other columns pass through, also such as are named like this module's inner columns.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import mphf
from .shared import arrow_map, fresh_path, integer_ids, read_file, write_file
from .text import Lines, lines, lowered, runs, slices, text_buffer

MIN_COUNT = 2
MIN_WORDS = 2
LINES_PER_SHARD = 4_000_000
_HELD_LINES, _HELD_BYTES = 1 << 20, 24 << 20
_NO_OWNER = np.iinfo(np.int64).max
_COUNTS = "lane0 bigint, lane1 bigint, n bigint, owner bigint"


def owners(column: pa.Array) -> np.ndarray:
    """``doc_id`` as ranks: nulls come last."""
    return column.cast(pa.int64()).fill_null(_NO_OWNER).to_numpy(zero_copy_only=False)


def _slice_lines(batch: pa.RecordBatch) -> tuple[Lines, np.ndarray, np.ndarray]:
    buf, off = text_buffer(lowered(batch.column("text")))
    return lines(buf, off), buf, off


def _count_lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got, _, _ = _slice_lines(batch)
            use = got.n_words >= min_words
            a, b, who = got.lane0[use], got.lane1[use], owners(batch.column("doc_id"))[got.row[use]]
            order = np.lexsort((who, b, a))
            a, b, who = a[order], b[order], who[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([new, [len(a)]]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[new].view(np.int64), b[new].view(np.int64), n.astype(np.int64), who[new])], ["lane0", "lane1", "n", "owner"])

    return run


def line_counts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Occurrences and lowest ``doc_id`` of every line of ``min_words`` words or more."""
    part = arrow_map(docs.select("doc_id", "text"), _count_lines(min_words), _COUNTS)
    return part.groupBy("lane0", "lane1").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))


class Shard:
    """One shard of the index, as views of its file: header, level sizes, bits, owners, fingerprints, ranks, counts."""

    def __init__(self, payload: memoryview):
        levels, n_bits, n = np.frombuffer(payload, np.int64, 3).tolist()
        at = 24
        views = []
        for kind, size in ((np.int64, levels), (np.uint64, n_bits), (np.int64, n), (np.uint64, n), (np.uint32, n_bits), (np.uint32, n)):
            views.append(np.frombuffer(payload, kind, size, at))
            at += views[-1].nbytes
        self.sizes, self.bits, self.owner, self.mark, self.rank, self.count = views
        self.nbytes = at

    @staticmethod
    def pack(lane0: np.ndarray, lane1: np.ndarray, n: np.ndarray, owner: np.ndarray) -> bytes:
        sizes, bits = mphf.build(lane0)
        rank = mphf.ranks(bits)
        slot = mphf.lookup(sizes, bits, rank, lane0)
        mark, count, own = np.zeros(len(slot), np.uint64), np.zeros(len(slot), np.uint32), np.zeros(len(slot), np.int64)
        mark[slot] = lane1
        count[slot] = np.minimum(n, 0xFFFFFFFF)
        own[slot] = owner
        return b"".join(x.tobytes() for x in (np.array([len(sizes), len(bits), len(slot)], np.int64), sizes, bits, own, mark, rank, count))

    def probe(self, lane0: np.ndarray, lane1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and owner of each line; count 0 where the shard doesn't hold the line."""
        if not len(self.mark):
            return np.zeros(len(lane0), np.uint32), np.zeros(len(lane0), np.int64)
        slot = mphf.lookup(self.sizes, self.bits, self.rank, lane0)
        safe = np.maximum(slot, 0)
        held = (slot >= 0) & (self.mark[safe] == lane1)
        return np.where(held, self.count[safe], 0), self.owner[safe]


def _write_shard(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        shard, a, b, n, owner = (t.column(c).to_numpy() for c in ("shard", "lane0", "lane1", "n", "owner"))
        for s in np.unique(shard):
            use = np.flatnonzero(shard == s)
            # Two lines that share all 64 bits of the key can't have two slots: the more frequent one is indexed.
            use = use[np.lexsort((-n[use], a[use]))]
            key = a[use].view(np.uint64)
            use = use[np.concatenate([[True], key[1:] != key[:-1]])]
            path = f"{folder}/{int(s):06d}.mph"
            write_file(path, Shard.pack(a[use].view(np.uint64), b[use].view(np.uint64), n[use], owner[use]))
            yield pa.RecordBatch.from_pydict({"shard": [int(s)], "path": [path], "n": [len(use)]}, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n", pa.int64())]))

    return run


class LineIndex:
    """Paths of the shards. Workers map a shard when they first probe it and keep at most ``held`` bytes of unmapped ones."""

    def __init__(self, shards: int, paths: dict[int, str], held: int = 512 << 20):
        self.shards, self.paths, self.held = shards, paths, held
        self._open: OrderedDict[int, Shard] = OrderedDict()

    def __getstate__(self):
        return {"shards": self.shards, "paths": self.paths, "held": self.held, "_open": OrderedDict()}

    def shard(self, s: int) -> Shard | None:
        if s not in self.paths:
            return None
        if s not in self._open:
            self._open[s] = Shard(read_file(self.paths[s]))
            while len(self._open) > 1 and not self.paths[s].startswith("file:") and sum(x.nbytes for x in self._open.values()) > self.held:
                self._open.popitem(last=False)
        self._open.move_to_end(s)
        return self._open[s]

    def probe(self, lane0: np.ndarray, lane1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 where below the threshold) and owner of each line."""
        count, owner = np.zeros(len(lane0), np.uint32), np.zeros(len(lane0), np.int64)
        which = (lane0 >> np.uint64(33)) % np.uint64(self.shards)
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            rows = order[cuts[s] : cuts[s + 1]]
            if len(rows) and (shard := self.shard(s)) is not None:
                count[rows], owner[rows] = shard.probe(lane0[rows], lane1[rows])
        return count, owner


def build_index(docs: DataFrame, min_count: int = MIN_COUNT, min_words: int = MIN_WORDS, lines_per_shard: int = LINES_PER_SHARD) -> LineIndex:
    """Count all lines and write the shards. Runs at once; what comes to the driver is one path a shard."""
    spark = docs.sparkSession
    repeated = line_counts(docs, min_words).where(F.col("n") >= min_count)
    folder = fresh_path(spark, "lines")
    repeated.write.parquet(f"{folder}/counts")
    repeated = spark.read.schema(_COUNTS).parquet(f"{folder}/counts")
    shards = max(1, -(-repeated.count() // lines_per_shard))
    which = F.pmod(F.shiftrightunsigned("lane0", 33), F.lit(shards)).cast("int")
    found = arrow_map(repeated.withColumn("shard", which).repartition(shards, "shard"), _write_shard(folder), "shard int, path string, n bigint").collect()
    return LineIndex(shards, {r.shard: r.path for r in found})


def _together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[tuple[pa.RecordBatch, Lines]]]:
    """Slices with their lines, so many at a time that they have ``rows`` lines or ``_HELD_BYTES`` of text."""
    held: list[tuple[pa.RecordBatch, Lines]] = []
    lines_held, bytes_held = 0, 0
    for batch in slices(batches, "text"):
        got, buf, _ = _slice_lines(batch)
        held.append((batch, got))
        lines_held, bytes_held = lines_held + len(got.row), bytes_held + len(buf)
        if lines_held >= rows or bytes_held >= _HELD_BYTES:
            yield held
            held, lines_held, bytes_held = [], 0, 0
    if held:
        yield held


def _filter_lines(index: LineIndex, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _together(batches, _HELD_LINES):
            longs = [np.flatnonzero(got.n_words >= min_words) for _, got in held]
            probed = index.probe(*(np.concatenate([getattr(got, lane)[long] for (_, got), long in zip(held, longs, strict=True)]) for lane in ("lane0", "lane1")))
            cuts = np.cumsum([len(x) for x in longs])[:-1]
            for (batch, got), long, count, owner in zip(held, longs, *(np.split(x, cuts) for x in probed), strict=True):
                yield _rebuilt(batch, got, _to_drop(got, long, count, owner, owners(batch.column("doc_id"))))

    return run


def _to_drop(got: Lines, long: np.ndarray, count: np.ndarray, owner: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Which lines of a slice go, given what the index says of the long ones."""
    drop = np.zeros(len(got.row), bool)
    repeated = np.flatnonzero(count > 0)
    at = long[repeated]
    drop[at] = owner[repeated] != who[got.row[at]]
    # Within its owner a line stays at its first position only.
    own = at[~drop[at]]
    order = own[np.lexsort((own, got.lane1[own], got.lane0[own], got.row[own]))]
    again = np.concatenate([[False], (got.row[order][1:] == got.row[order][:-1]) & (got.lane0[order][1:] == got.lane0[order][:-1]) & (got.lane1[order][1:] == got.lane1[order][:-1])]) if len(order) else np.zeros(0, bool)
    drop[order[again]] = True
    return drop


def _rebuilt(batch: pa.RecordBatch, got: Lines, drop: np.ndarray) -> pa.RecordBatch:
    n = batch.num_rows
    total = np.bincount(got.row, minlength=n)
    lost = np.bincount(got.row[drop], minlength=n)
    text = batch.column("text")
    if drop.any():
        raw, off = text_buffer(text)
        keep = ~drop
        # A kept line brings the line feed before it, unless it is the first one kept of its row.
        rows = got.row[keep]
        first = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
        begin = got.start[keep] - ~first
        size = got.end[keep] - begin
        body = raw[runs(size, begin)]
        lengths = np.bincount(rows, weights=size, minlength=n).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        fresh = wide.cast(pa.large_string()).cast(text.type)
        text = pc.if_else(text.is_valid(), fresh, pa.scalar(None, text.type))
    columns = [text if name == "text" else batch.column(name) for name in batch.schema.names]
    columns += [pa.array(total, pa.int32()), pa.array(lost, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, min_count: int = MIN_COUNT, min_words: int = MIN_WORDS, lines_per_shard: int = LINES_PER_SHARD) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and the columns ``n_lines`` and ``n_removed``.

    A column of ``docs`` that has one of those two names is replaced.
    """
    integer_ids(docs, "doc_id")
    docs = docs.drop("n_lines", "n_removed")
    index = build_index(docs, min_count, min_words, lines_per_shard)
    out = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_removed", T.IntegerType())])
    return arrow_map(docs, _filter_lines(index, min_words), out)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after line dedup, the number of its lines and of those removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)


OP5_SQL = r"""
WITH units AS (
  SELECT doc_id, ord, line,
         trim(regexp_replace(lower(line), '[^0-9a-z\x{80}-\x{10ffff}]+', ' ', 'g')) AS unit
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS ord
        FROM documents WHERE text <> '')
), ranked AS (
  SELECT *, len(unit) - len(replace(unit, ' ', '')) + 1 AS n_words,
         count(*) OVER (PARTITION BY unit) AS n,
         row_number() OVER (PARTITION BY unit ORDER BY doc_id, ord) AS rank
  FROM units
), marked AS (
  SELECT *, (n >= 2 AND n_words >= 2 AND rank > 1) AS gone FROM ranked
), merged AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT gone) AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN m.doc_id IS NULL THEN d.text ELSE coalesce(m.text, '') END AS text,
       CAST(coalesce(m.n_lines, 0) AS INTEGER) AS n_lines,
       CAST(coalesce(m.n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN merged m ON d.doc_id = m.doc_id
"""
