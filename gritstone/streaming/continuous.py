"""Continuous forms of the roll-up, the last-N window, age-off and change hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import summarise
from ..sources.tables import put_last_n

_WINDOWS = {"MINUTES": "1 minute", "HOURS": "1 hour", "DAYS": "1 day"}


def continuous_rollup(stream: DataFrame, unit: str, late: str, by: tuple[str, ...] = ("grp", "type", "name", "vis")) -> DataFrame:
    """Summaries by time window of a stream ``(ts, value, *by)``; state older than ``late`` is let go."""
    marked = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = marked.groupBy(*by, F.window("at", _WINDOWS[unit]).alias("w")).agg(*summarise(F.col("value")))
    return out.select(*by, F.col("w.start").cast("timestamp_ntz").alias("bucket"), "min", "max", "sum", "count", "sum_square")


def continuous_change_hashes(stream: DataFrame, size: str, late: str) -> DataFrame:
    """A hash for each time bucket of a stream ``(ts, hash)``, once the bucket is complete."""
    marked = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = marked.groupBy(F.window("at", size).alias("w")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("hash")), ",")).alias("hash"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "hash")


def keep_latest(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of updates (of an aggregation by time) as one directory a batch; ``latest`` reads what holds now."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(written: DataFrame, *key: str) -> DataFrame:
    """Of rows with a ``batch``, the one of the last batch for each key."""
    rest = [c for c in written.columns if c not in (*key, "batch")]
    return written.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*key, "row.*")


def aged_off(stream: DataFrame, ttl: str) -> DataFrame:
    """Drop events that are older than ``ttl`` or from the future when they arrive."""
    now = F.current_timestamp()
    at = F.col("ts").cast("timestamp")
    return stream.where((at <= now) & (at >= now - F.expr(f"interval {ttl}")))


def keep_last_n(stream: DataFrame, path: str, n: int, group: str, ts: str, id_: str, checkpoint: str, slots: int = 64) -> StreamingQuery:
    """Keep each group's newest ``n`` events of a stream as a table, whatever order they arrive in.

    Each batch is put into the table at ``path``; only the directories of its groups are read and written again. Late events
    count, and only push out older ones. A batch that is repeated changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        put_last_n(batch, path, n, group, ts, id_, slots)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
