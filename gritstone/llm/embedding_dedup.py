"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one vector a group kept.

There are about ``sqrt(n)`` cells, so assigning vectors and comparing within cells both cost ``n ** 1.5``
products. Centroids start from the vectors with the smallest hashes and are refined by a few passes over
all vectors; only sums a cell come to the driver.

A vector is compared, as a query, in its nearest cell. So that partners across a border meet, it is also
a candidate in every other cell that is nearly as close: within ``reach`` standard deviations of how far two vectors at the
threshold differ along the line between the two centroids, if their difference has a random direction. As either of two partners may be the
one nearer to the border, a reach of 1.25 loses no more than 2.5 of the sum's deviations do, about one pair in eighty at the threshold
itself. That is approximate on purpose (recall is measured in the tests); within a cell everything is compared. Cells with many
vectors are split into blocks, and each pair of blocks is a piece of work of its own.

Groups are the connected components of the pairs at ``min_cosine`` or more; the smallest ``vec_id`` stays.

Defined results for odd input: a vector that is null, has a null, NaN or infinite element, is all zeros, or
is not as long as most are, has no partner; neither has one without ``vec_id``. Rows with the same
``vec_id`` are the same vector; a ``vec_id`` that is no integer is refused. Length doesn't matter, only direction. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import ONE_TASK_EDGES, components, label_edges, starts_of, whole_runs
from .shared import arrow_map, integer_ids, stored
from .text import runs

MIN_COSINE = 0.9
ITERATIONS = 4
REACH = 1.25
BLOCK_ROWS = 4096


def _rows(batch: pa.RecordBatch, column: str = "unit") -> np.ndarray:
    cells = batch.column(column)
    flat = np.frombuffer(cells.buffers()[2], np.float32) if len(cells) else np.zeros(0, np.float32)
    wide = np.int64 if pa.types.is_large_binary(cells.type) else np.int32
    off = np.frombuffer(cells.buffers()[1], wide)[cells.offset : cells.offset + len(cells) + 1] if len(cells) else np.zeros(1, np.int32)
    return flat[off[0] // 4 : off[-1] // 4].reshape(len(cells), -1) if len(cells) else np.zeros((0, 1), np.float32)


def _pack(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    off = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off), pa.py_buffer(x.tobytes())])


def _units(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            x = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dim)
            norm = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            ids = batch.column("vec_id").cast(pa.int64()).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, _pack(x[good] / norm[good, None])], ["vec", "unit"])

    return run


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cell of each unit vector; the lower one in a tie."""
    return np.concatenate([(x[i : i + 1024] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)


def _sums(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        total = np.zeros(c.shape, np.float64)
        for batch in batches:
            x = _rows(batch)
            if len(x):
                np.add.at(total, nearest(x, c), x)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), _pack(total[used])], ["cell", "unit"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_runs(batches, "cell"):
        b = t.combine_chunks().to_batches()[0]
        cell = b.column("cell").to_numpy()
        at = starts_of(cell)
        yield pa.RecordBatch.from_arrays([pa.array(cell[at]), _pack(np.add.reduceat(_rows(b).astype(np.float64), at, axis=0))], ["cell", "unit"])


def fit_cells(units: DataFrame, cells: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Unit centroids of ``cells`` cells, refined over all vectors."""
    spark = units.sparkSession
    seeds = units.orderBy(F.xxhash64("vec"), "vec").limit(cells).collect()
    c = np.array([np.frombuffer(r.unit, np.float32) for r in seeds])
    for _ in range(iterations):
        held = spark.sparkContext.broadcast(c)
        parts = arrow_map(units, _sums(held), "cell bigint, unit binary")
        rows = arrow_map(parts.repartition("cell").sortWithinPartitions("cell"), _add, "cell bigint, unit binary").collect()
        held.unpersist()
        new = c.copy()
        for r in rows:
            v = np.frombuffer(r.unit, np.float32)
            if (norm := float(np.linalg.norm(v))) > 1e-6:
                new[r.cell] = v / norm
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def cells_of(x: np.ndarray, centroids: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and cell of each vector's places, and whether it is its own cell.

    Another cell is a place where the own centroid is closer by no more than ``slack`` times the two centroids' distance.
    """
    s = x @ centroids.T
    best = s.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centroids[best] @ centroids.T)))
    row, cell = np.nonzero(s.max(axis=1, keepdims=True) - s <= slack * apart)
    own = best[row] == cell
    rest = ~own
    # The own cell comes first and once, also where two centroids are the same.
    return np.concatenate([np.arange(len(x)), row[rest]]), np.concatenate([best, cell[rest]]), np.arange(len(x) + int(rest.sum())) < len(x)


def _count_places(held, slack: float):
    """How many vectors have each cell as their own, and as a place at all, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        counts = np.zeros((2, len(c)), np.int64)
        for batch in batches:
            x = _rows(batch)
            for i in range(0, len(x), 512):
                _, cell, home = cells_of(x[i : i + 512], c, slack)
                counts += [np.bincount(cell[home], minlength=len(c)), np.bincount(cell, minlength=len(c))]
        used = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(n[used]) for n in counts)], ["cell", "home", "n"])

    return run


def _places(held, slack: float):
    """Each vector's cells: its own (as query and candidate) and those nearly as close (as candidate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            ids, x = batch.column("vec").to_numpy(), _rows(batch)
            for i in range(0, len(x), 512):
                row, cell, home = cells_of(x[i : i + 512], c, slack)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ids[i + row]), pa.array(home), _pack(x[i + row])], ["cell", "vec", "home", "unit"])

    return run


def _spread(held, block_rows: int):
    """Copies of each placed vector for all pairs of blocks that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, all_ = (-(-x // block_rows) for x in held.value)
        for batch in batches:
            cell, vec, home = batch.column("cell").to_numpy(), batch.column("vec").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False)
            mixed = (vec.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for query in (True, False):
                use = np.flatnonzero(home) if query else np.arange(len(cell))
                n_own, n_other = (homes, all_) if query else (all_, homes)
                n = n_other[cell[use]]
                row = np.repeat(use, n)
                own = (mixed[row] % np.maximum(n_own[cell[row]], 1).astype(np.uint64)).astype(np.int64)
                other = runs(n, np.zeros(len(n), np.int64))
                task = cell[row] * (1 << 40) + (own if query else other) * (1 << 20) + (other if query else own)
                yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(vec[row]), pa.array(np.full(len(row), query)), batch.column("unit").take(pa.array(row))], ["task", "vec", "query", "unit"])

    return run


def _compare(min_cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "task"):
            b = t.combine_chunks().to_batches()[0]
            task, vec, query, x = b.column("task").to_numpy(), b.column("vec").to_numpy(), b.column("query").to_numpy(zero_copy_only=False), _rows(b)
            at = starts_of(task)
            for lo, hi in zip(at, [*at[1:], len(task)], strict=True):
                q = query[lo:hi]
                qx, cx, qv, cv = x[lo:hi][q], x[lo:hi][~q], vec[lo:hi][q], vec[lo:hi][~q]
                a, z = [], []
                for i in range(0, len(qx), 512):
                    r, c = np.nonzero(qx[i : i + 512] @ cx.T >= min_cosine)
                    use = qv[i + r] != cv[c]
                    # Spanning edges say all that components need.
                    if use.any():
                        node, root = label_edges(qv[i + r][use], cv[c][use])
                        a.append(node[node != root])
                        z.append(root[node != root])
                if a:
                    node, root = label_edges(np.concatenate(a), np.concatenate(z))
                    use = node != root
                    yield pa.RecordBatch.from_arrays([pa.array(node[use]), pa.array(root[use])], ["a", "b"])

    return run


def near_duplicate_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, cells: int | None = None, iterations: int = ITERATIONS, reach: float = REACH, block_rows: int = BLOCK_ROWS, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``(vec_id, duplicate_of)``: each vector that isn't its group's representative, with that one."""
    spark = vectors.sparkSession
    integer_ids(vectors, "vec_id")
    named = vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL AND size(embedding) > 0")
    lengths = named.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "vec_id bigint, duplicate_of bigint")
    dim, n = lengths[0]["d"], lengths[0]["count"]
    units = stored(arrow_map(named.where(F.size("embedding") == dim), _units(dim), "vec bigint, unit binary"), "units")
    if not units.head(1):
        return spark.createDataFrame([], "vec_id bigint, duplicate_of bigint")
    centroids = fit_cells(units, cells or math.ceil(math.sqrt(n)), iterations)
    held = spark.sparkContext.broadcast(centroids)
    slack = reach * math.sqrt(2 * (1 - min_cosine)) / math.sqrt(dim)
    placed = arrow_map(units, _places(held, slack), "cell bigint, vec bigint, home boolean, unit binary")
    counts = arrow_map(units, _count_places(held, slack), "cell bigint, home bigint, n bigint").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("n").alias("n")).collect()
    sizes = np.zeros((2, len(centroids)), np.int64)
    for r in counts:
        sizes[:, r.cell] = r.home, r.n
    spread = arrow_map(placed, _spread(spark.sparkContext.broadcast(sizes), block_rows), "task bigint, vec bigint, query boolean, unit binary")
    edges = arrow_map(spread.repartition("task").sortWithinPartitions("task"), _compare(min_cosine), "a bigint, b bigint")
    return components(edges, one_task_edges).where("node <> root").select(F.col("node").alias("vec_id"), F.col("root").alias("duplicate_of"))


def drop_near_duplicate_vectors(vectors: DataFrame, **settings) -> DataFrame:
    """``vectors`` without the duplicates, all columns as they were."""
    gone = near_duplicate_vectors(vectors, **settings).select(F.col("vec_id").alias("gone"))
    return vectors.join(gone, vectors["vec_id"] == gone["gone"], "left_anti")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that stay: all but the near copies of others."""
    return drop_near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "label")
