"""MinHash near-dedup by an inverted join of signature coordinates.

A signature has ``COORDINATES`` minima over the hashes of a document's word shingles. Two documents are
near copies if at least ``MIN_EQUAL`` coordinates are equal. Each document is posted under each of its
coordinate-value pairs, and collisions are counted:

1. Postings are counted by pair in one shuffle. A pair that only one document has can't collide; a
   document with fewer than ``MIN_EQUAL`` shared pairs has no partner and drops out. That is most documents.
2. Prefix: with pairs in one global order, rarest first, two partners must share one of each one's first
   ``COORDINATES - MIN_EQUAL + 1`` pairs. Only these are merged. Skip: the remaining, most frequent
   lists (phrases half the corpus has) are never merged, only counted when two signatures are compared.
3. In each list the first document meets all others; verified collisions make components. Then lists
   that still hold several components meet once more, across components only. So every pair that
   could add a connection is compared, while a list of ten thousand copies costs ten thousand comparisons.
   Lists meet in blocks of ``BLOCK`` documents, each pair of blocks a piece of work of its own, with the signatures at hand: no pair is
   written down but those above the threshold, and no task holds more than two blocks of a list.

What is kept is the connected components of the pairs above the threshold: each document but the
smallest ``doc_id`` of its component is a duplicate of that one.

Defined results for odd input: texts without a word (null and empty ones too) and rows without a
``doc_id`` have no partner. Documents of one or two words have one shingle, all their words. Rows with
the same ``doc_id`` are the same document; a ``doc_id`` that is no integer is refused. An empty table gives an
empty one; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import ONE_TASK_EDGES, components, label_edges, starts_of, whole_runs
from .shared import arrow_map, integer_ids, stored
from .text import Words, lowered, mix, runs, slices, text_buffer, words

COORDINATES = 80
MIN_EQUAL = 36
SHINGLE = 3
BLOCK = 1024
_FREQUENT = 1 << 21
_MULTIPLIER = np.random.default_rng(15_485_863).integers(1, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ABSENT = np.uint64(0x5851F42D4C957F2D)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word shingles, the first one's index of each row that has words, and those rows."""
    n = np.diff(w.first)
    rows = np.flatnonzero(n)
    count = np.maximum(n[rows] - size + 1, 1)
    at = runs(count, w.first[rows])
    end = np.repeat(w.first[rows + 1], count)
    h = w.hash[at] * _MULTIPLIER[511]
    for k in range(1, size):
        later = np.minimum(at + k, len(w.hash) - 1)
        h += np.where(at + k < end, w.hash[later], _ABSENT) * _MULTIPLIER[511 - k]
    return mix(h), np.cumsum(count) - count, rows


def signatures(column: pa.Array, coordinates: int = COORDINATES, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have words, and their signatures."""
    h, begin, rows = shingles(words(*text_buffer(lowered(column))), size)
    out = np.empty((len(rows), coordinates), np.uint64)
    if len(rows):
        # A few rows at a time, so that all passes over their shingles stay in cache.
        at = 0
        stops = np.concatenate([begin, [len(h)]])
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(stops, stops[at] + 16384, "right")) - 1)
            part, local = h[stops[at] : stops[to]], begin[at:to] - stops[at]
            work = np.empty_like(part)
            for k in range(coordinates):
                np.multiply(part, _MULTIPLIER[k], out=work)
                out[at:to, k] = np.minimum.reduceat(work, local)
            at = to
    return rows, mix(out.ravel()).reshape(out.shape)


def _sign(coordinates: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, sig = signatures(batch.column("text"), coordinates, size)
            cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(coordinates * 8), len(rows), [None, pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)).cast(pa.int64()), cells.cast(pa.binary())], ["doc", "sig"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    buf, off = text_buffer(column)
    return buf.view(np.uint64).reshape(len(off) - 1, -1) if len(buf) else np.zeros((0, 1), np.uint64)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and coordinate-value pair, as the pair's 64-bit hash."""
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            sig = _matrix(part.column("sig"))
            key = (sig + np.arange(1, sig.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * _MULTIPLIER[500]
            doc = part.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(doc, sig.shape[1]))], ["key", "doc"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by key: those of keys with several documents, with the number of documents (up to a bound)."""

    def rows(t: pa.Table, frequent: bool) -> pa.RecordBatch:
        key, doc = t.column("key").to_numpy(), t.column("doc").to_numpy()
        at = starts_of(key)
        n = np.diff(np.concatenate([at, [len(key)]]))
        n = np.repeat(np.full(len(at), _FREQUENT) if frequent else np.minimum(n, _FREQUENT), n)
        use = n > 1
        return pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(doc[use]), pa.array(n[use].astype(np.int32))], ["key", "doc", "n"])

    held: list[pa.RecordBatch] = []
    size, long = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column("key").to_numpy()
        if long is not None:
            same = int(np.searchsorted(k != long, True)) if k[0] == long else 0
            if same:
                yield rows(pa.Table.from_batches([batch.slice(0, same)]), True)
                batch, k = batch.slice(same), k[same:]
            if not len(k):
                continue
            long = None
        cut = int(starts_of(k)[-1])
        if held and (cut or held[-1].column("key")[-1].as_py() != k[0]):
            new = held[-1].column("key")[-1].as_py() != k[0]
            if new:
                yield rows(pa.Table.from_batches(held), False)
                held, size = [], 0
        if cut:
            yield rows(pa.Table.from_batches([*held, batch.slice(0, cut)]), False)
            held, size = [], 0
        held.append(batch.slice(cut))
        size += batch.num_rows - cut
        if size >= _FREQUENT:
            long = int(k[-1])
            yield rows(pa.Table.from_batches(held), True)
            held, size = [], 0
    if held:
        yield rows(pa.Table.from_batches(held), False)


def _prefix(min_equal: int):
    """Shared postings sorted by document, rarest first: the prefix of each document that may have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "doc"):
            doc, key, n = (t.column(c).to_numpy() for c in ("doc", "key", "n"))
            order = np.lexsort((key, n, doc))
            doc, key = doc[order], key[order]
            # Equal keys of rows with one doc_id count once.
            pair = np.lexsort((key, doc))
            again = np.zeros(len(doc), bool)
            again[pair[1:]] = (doc[pair[1:]] == doc[pair[:-1]]) & (key[pair[1:]] == key[pair[:-1]])
            doc, key = doc[~again], key[~again]
            at = starts_of(doc)
            have = np.diff(np.concatenate([at, [len(doc)]]))
            take = np.maximum(have - min_equal + 1, 0)
            use = runs(take, at)
            yield pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(doc[use])], ["key", "doc"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by key and document: each list's first document with every other one, once a batch."""
    last_key, last_doc = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
        at = starts_of(key)
        n = np.diff(np.concatenate([at, [len(key)]]))
        lead = doc[at].copy()
        if last_key is not None and key[0] == last_key:
            lead[0] = last_doc
        last_key, last_doc = key[-1], lead[-1]
        a, b = np.repeat(lead, n), doc
        use = a != b
        pairs = np.unique(np.stack([a[use], b[use]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _links(a: np.ndarray, b: np.ndarray, min_equal: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the rows of two blocks of signatures that are equal in ``min_equal`` coordinates, a part at a time."""
    step = max(1, (1 << 22) // max(1, b.size))
    for i in range(0, len(a), step):
        r, c = np.nonzero((a[i : i + step, None, :] == b[None, :, :]).sum(axis=2, dtype=np.uint16) >= min_equal)
        yield r + i, c


def _across(min_equal: int):
    """Blocks of lists with several components: links between two components, as few as connect what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "task"):
            t = t.combine_chunks()
            task, key, doc, root, own, lo, hi = (t.column(c).to_numpy() for c in ("task", "key", "doc", "root", "own", "lo", "hi"))
            sig = _matrix(t.column("sig").chunk(0))
            at = starts_of(task, key, lo, hi)
            for i, j in zip(at, [*at[1:], len(task)], strict=True):
                one = np.arange(i, j)[own[i:j] == lo[i]]
                two = one if lo[i] == hi[i] else np.arange(i, j)[own[i:j] == hi[i]]
                found = [(doc[one[r]][use], doc[two[c]][use]) for r, c in _links(sig[one], sig[two], min_equal) if (use := root[one[r]] != root[two[c]]).any()]
                if found:
                    node, least = label_edges(*(np.concatenate(x) for x in zip(*found, strict=True)))
                    use = node != least
                    yield pa.RecordBatch.from_arrays([pa.array(node[use]), pa.array(least[use])], ["a", "b"])

    return run


def _verify(min_equal: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = (_matrix(batch.column("sig_a")) == _matrix(batch.column("sig_b"))).sum(axis=1) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(equal >= min_equal))

    return run


def _verified(pairs: DataFrame, signed: DataFrame, min_equal: int) -> DataFrame:
    """Candidate pairs, each once, that reach the threshold."""
    pairs = pairs.distinct()
    a = signed.select(F.col("doc").alias("a"), F.col("sig").alias("sig_a"))
    b = signed.select(F.col("doc").alias("b"), F.col("sig").alias("sig_b"))
    return arrow_map(pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b"), _verify(min_equal), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, coordinates: int = COORDINATES, min_equal: int = MIN_EQUAL, shingle: int = SHINGLE, one_task_edges: int = ONE_TASK_EDGES, block: int = BLOCK) -> DataFrame:
    """``(doc_id, duplicate_of)``: each document that is a near copy, and the smallest ``doc_id`` of its group."""
    integer_ids(docs, "doc_id")
    signed = stored(arrow_map(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), _sign(coordinates, shingle), "doc bigint, sig binary"), "signatures")
    posted = arrow_map(signed, _post, "key bigint, doc bigint")
    counted = arrow_map(posted.repartition("key").sortWithinPartitions("key"), _shared, "key bigint, doc bigint, n int")
    prefix = arrow_map(counted.repartition("doc").sortWithinPartitions("doc"), _prefix(min_equal), "key bigint, doc bigint")
    prefix = stored(prefix, "prefix")
    stars = arrow_map(prefix.repartition("key").sortWithinPartitions("key", "doc"), _stars, "a bigint, b bigint")
    first = stored(_verified(stars, signed, min_equal), "pairs")
    roots = stored(components(first, one_task_edges), "roots")
    rooted = prefix.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
    blocks = F.ceil(F.col("n") / block)
    posted = rooted.join(split, "key").select("key", "doc", "root", F.pmod(F.xxhash64("doc"), blocks).alias("own"), blocks.alias("blocks"))
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = posted.select("key", "doc", "root", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).withColumn("task", F.xxhash64("key", "lo", "hi"))
    held = met.join(signed, "doc").repartition("task").sortWithinPartitions("task", "key", "lo", "hi")
    second = arrow_map(held, _across(min_equal), "a bigint, b bigint")
    # Rows of one doc_id count as one document, so their signatures may meet under other numbers only.
    joined = first.union(second)
    return components(joined, one_task_edges).where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the near copies; of each group the smallest ``doc_id`` stays. All columns as they were."""
    gone = near_duplicates(docs, **settings).select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is a near copy of another one, with the one of its group that stays."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
