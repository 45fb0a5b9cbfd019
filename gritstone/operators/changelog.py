"""Change detection: hashes of events by time bucket, hash trees over the buckets, and their difference."""

from __future__ import annotations

from datetime import datetime
from hashlib import md5
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BUCKETS, bucket_floor
from ..plans.criteria import literal
from ..sources.scratch import stored

DEFAULT_BUCKET = BUCKETS["FIVE_MINS"]
EMPTY = ""


def event_hash(id_: Column, attrs: Column) -> Column:
    """MD5 of the id and the attributes ``(key, value, meta)`` in their canonical order, whatever order they come in."""
    parts = F.transform(F.array_sort(attrs), lambda a: F.concat(a["key"], F.char(F.lit(0)), a["value"], F.char(F.lit(0)), a["meta"], F.lit(",")))
    return F.md5(F.concat(id_.cast("string"), F.array_join(parts, "")))


def bucket_leaves(events: DataFrame, start: datetime, stop: datetime, size_ms: int = DEFAULT_BUCKET) -> DataFrame:
    """A leaf ``(idx, bucket, hash)`` for each bucket from ``start`` to ``stop``, of ``events(ts, hash)``.

    A bucket's hash is that of its events' hashes in order; a bucket without events has the hash of nothing.
    So trees of two sides over the same period have the same shape.
    """
    spark = events.sparkSession
    lo, hi = (spark.range(1).select(bucket_floor(literal(t), size_ms).alias("b")).first().b for t in (start, stop))
    spine = spark.range(0, (hi - lo) // size_ms + 1).select(F.col("id").alias("idx"), (F.lit(lo) + F.col("id") * size_ms).alias("bucket"))
    own = events.where((F.col("ts") >= literal(start)) & (F.col("ts") <= literal(stop)))
    have = own.groupBy(bucket_floor(F.col("ts"), size_ms).alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list("hash")), ",").alias("hashes"))
    return spine.join(have, "bucket", "left").select("idx", "bucket", F.md5(F.coalesce("hashes", F.lit(EMPTY))).alias("hash"))


def next_level(nodes: DataFrame, dims: int = 2) -> DataFrame:
    """Parents ``(idx, hash)``: MD5 of the children's hashes, each followed by a zero; an only child moves up as it is."""
    gathered = nodes.groupBy(F.floor(F.col("idx") / dims).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda c: F.concat(c["hash"], F.char(F.lit(0)))), "")
    return gathered.select("idx", F.when(F.size("c") == 1, F.col("c")[0]["hash"]).otherwise(F.md5(joined)).alias("hash"))


SUBTREE = 4_096


def _subtrees(dims: int, height: int, base: int):
    """Nodes of one subtree, from its lowest level's nodes: those of up to ``height`` levels above."""

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table.column("idx")).to_pylist()
        idx, hashes = table.column("idx").to_pylist(), table.column("hash").to_pylist()
        nodes = [(idx[k], hashes[k]) for k in order]
        out = []
        for level in range(base + 1, base + height + 1):
            above = []
            for parent, group in groupby(nodes, lambda n: n[0] // dims):
                children = [h for _, h in group]
                above.append((parent, children[0] if len(children) == 1 else md5("".join(h + "\0" for h in children).encode()).hexdigest()))
            nodes = above
            out += [(level, *n) for n in nodes]
        level, number, value = zip(*out, strict=True)
        return pa.table({"level": pa.array(level, pa.int32()), "idx": pa.array(number, pa.int64()), "hash": pa.array(value, pa.string())})

    return run


def tree(leaves: DataFrame, n_leaves: int, dims: int = 2) -> list[DataFrame]:
    """Levels of the hash tree, leaves first, the root last."""
    levels = [leaves.select("idx", "hash")]
    while n_leaves > 1:
        levels.append(next_level(levels[-1], dims))
        n_leaves = -(-n_leaves // dims)
    return levels


def tree_frame(leaves: DataFrame, n_leaves: int, dims: int = 2) -> DataFrame:
    """All nodes as ``(level, idx, hash)``.

    Subtrees of up to ``SUBTREE`` nodes at their lowest level are built by one task each, so the tree of a million leaves takes two
    shuffles. Each round is stored, and the next one begins with its highest nodes.
    """
    height, width = 1, dims
    while width * dims <= SUBTREE:
        height, width = height + 1, width * dims
    top = 0
    while dims**top < n_leaves:
        top += 1
    nodes, base = leaves.select("idx", "hash"), 0
    if top:
        nodes = stored(nodes, "tree-leaves")
    out = nodes.select(F.lit(0).alias("level"), "idx", "hash")
    while base < top:
        up = min(height, top - base)
        grouped = nodes.groupBy(F.floor(F.col("idx") / dims**up).alias("subtree"))
        built = stored(grouped.applyInArrow(_subtrees(dims, up, base), "level int, idx bigint, hash string"), "tree-nodes")
        out, base = out.unionByName(built), base + up
        nodes = built.where(F.col("level") == base).select("idx", "hash")
    return out


def descend(mine: DataFrame, theirs: DataFrame, dims: int = 2, fan: int = 64) -> DataFrame:
    """Leaves ``(idx, mine, theirs)`` that differ, found from the root of two trees ``(level, idx, hash)`` down.

    Only what lies under nodes that differ is looked at, some levels at a time (those that ``fan`` nodes lie under one in), so of
    trees that are nearly alike little is read, in few rounds. Trees of different sizes can't be compared.
    """
    sizes = [sorted(tuple(r) for r in t.groupBy("level").count().collect()) for t in (mine, theirs)]
    if sizes[0] != sizes[1] or not sizes[0]:
        raise ValueError("trees of different sizes, or without nodes, can't be compared")
    stride = 1
    while dims ** (stride + 1) <= fan:
        stride += 1
    level, asked = len(sizes[0]) - 1, None
    while True:
        a, b = (t.where(F.col("level") == level).select("idx", F.col("hash").alias(n)) for t, n in ((mine, "mine"), (theirs, "theirs")))
        if asked is not None:
            a = a.join(asked, "idx", "left_semi")
        differ = a.join(b, "idx").where("mine <> theirs")
        if level == 0:
            return differ
        below = max(0, level - stride)
        width = dims ** (level - below)
        asked = differ.select(F.explode(F.sequence(F.col("idx") * width, F.col("idx") * width + width - 1)).alias("idx"))
        level = below


def diff(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Buckets whose hashes differ, or that only one side has."""
    a, b = (t.select("bucket", F.col("hash").alias(n)) for t, n in ((mine, "mine"), (theirs, "theirs")))
    return a.join(b, "bucket", "full").where(~F.col("mine").eqNullSafe(F.col("theirs")))


def changes(events: DataFrame, buckets: DataFrame, size_ms: int = DEFAULT_BUCKET) -> DataFrame:
    """The events of the given buckets."""
    return events.withColumn("bucket", bucket_floor(F.col("ts"), size_ms)).join(buckets.select("bucket"), "bucket", "left_semi")
