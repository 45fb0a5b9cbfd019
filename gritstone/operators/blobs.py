"""Blobs as numbered chunks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.visibility import visible

CHUNK = 1 << 20


def chunks(blobs: DataFrame, size: int = CHUNK) -> DataFrame:
    """``blobs(key, type, data, ts, vis, properties)`` cut into chunks, numbered from 1; empty data gives none."""
    n = F.ceil(F.octet_length("data") / size).cast("int")
    rows = blobs.where(F.octet_length("data") > 0).select("*", F.explode(F.sequence(F.lit(1), n)).alias("seq"))
    return rows.withColumn("data", F.substring("data", (F.col("seq") - 1) * size + 1, F.lit(size)))


def newest(stored: DataFrame) -> DataFrame:
    """Of each blob only the chunks of its newest write."""
    last = F.max("ts").over(Window.partitionBy("key", "type"))
    return stored.withColumn("last", last).where("ts = last").drop("last")


def get(stored: DataFrame, auths: Iterable[str] | None = None) -> DataFrame:
    """Blobs put together again, chunks in order."""
    own = newest(stored if auths is None else visible(stored, auths))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "data")))
    whole = own.groupBy("key", "type").agg(ordered.alias("parts"), F.max("ts").alias("ts"))
    empty = F.expr("X''")
    return whole.select("key", "type", "ts", F.aggregate("parts", empty, lambda a, p: F.concat(a, p["data"])).alias("data"))


def sizes(stored: DataFrame, auths: Iterable[str] | None = None) -> DataFrame:
    """Bytes and chunks of each blob, without putting it together."""
    own = newest(stored if auths is None else visible(stored, auths))
    return own.groupBy("key", "type").agg(F.sum(F.octet_length("data")).cast("bigint").alias("size"), F.count("*").alias("n_chunks"))


def properties(stored: DataFrame, auths: Iterable[str] | None = None) -> DataFrame:
    """Each blob's properties."""
    own = newest(stored if auths is None else visible(stored, auths))
    return own.where("seq = 1").select("key", "type", "properties")
