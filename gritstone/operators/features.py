"""Metrics: mergeable summaries of long values, rolled up by time unit.

A roll-up is one aggregation. Its columns can be rolled up again (hours into days) with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import truncate
from ..functions.visibility import visible
from ..plans.criteria import literal

SUMMARY = ("min", "max", "sum", "count", "sum_square")


def summarise(value: Column) -> list[Column]:
    """The summary of raw values; the sum of squares is exact."""
    v = value.cast("decimal(19,0)")
    return [F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.count(value).alias("count"), F.sum((v * v).cast("decimal(38,0)")).cast("decimal(38,0)").alias("sum_square")]


def merge() -> list[Column]:
    """The summary of summaries."""
    return [F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.sum("sum_square").cast("decimal(38,0)").alias("sum_square")]


def with_moments(metrics: DataFrame) -> DataFrame:
    """Adds mean (0 without values), population variance (0 below two values, never negative) and its root."""
    n, mean = F.col("count"), F.col("sum").cast("double") / F.col("count")
    out = metrics.withColumn("mean", F.when(n < 1, F.lit(0.0)).otherwise(mean))
    var = F.greatest(F.lit(0.0), F.col("sum_square").cast("double") / n - F.col("mean") * F.col("mean"))
    return out.withColumn("variance", F.when(n < 2, F.lit(0.0)).otherwise(var)).withColumn("std_dev", F.sqrt("variance"))


def rollup(features: DataFrame, unit: str, by: Iterable[str] = ("grp", "type", "name", "vis")) -> DataFrame:
    """Summaries of ``features(ts, value, *by)`` by time bucket."""
    return features.groupBy(*by, truncate(unit, F.col("ts")).alias("bucket")).agg(*summarise(F.col("value")))


def rollups(features: DataFrame, units: Iterable[str], by: Iterable[str] = ("grp", "type", "name", "vis")) -> DataFrame:
    """Several units in one pass: finest first, the coarser ones from its result."""
    order = [u for u in ("MINUTES", "HOURS", "DAYS", "MONTHS") if u in set(units)]
    finest = rollup(features, order[0], by)
    out = finest.select(F.lit(order[0]).alias("unit"), "*")
    for unit in order[1:]:
        coarse = finest.groupBy(*by, truncate(unit, F.col("bucket")).alias("bucket")).agg(*merge())
        out = out.unionByName(coarse.select(F.lit(unit).alias("unit"), "*"))
    return out


def query(metrics: DataFrame, start: datetime, end: datetime, group: str | None = None, types: Iterable[str] | None = None, name: str | None = None, auths: Iterable[str] | None = None) -> DataFrame:
    """Summaries of a time range (both ends included) and of the given group, types and name; None asks nothing."""
    out = metrics.where((F.col("bucket") >= literal(start)) & (F.col("bucket") <= literal(end)))
    for column, value in (("grp", group), ("name", name)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out if types is None else out.where(F.col("type").isin(*sorted(types)))
    return out if auths is None else visible(out, auths)


def names(features: DataFrame, of: str, prefix: str = "", **fixed: str) -> DataFrame:
    """Distinct groups, types or names with a prefix, where the other columns have given values."""
    rows = features.where(F.col(of).startswith(prefix))
    for column, value in fixed.items():
        rows = rows.where(F.col(column) == value)
    return rows.select(of).distinct()


def custom_rollup(features: DataFrame, unit: str, aggregates: Iterable[Column], by: Iterable[str] = ("grp", "type", "name", "vis")) -> DataFrame:
    """A roll-up with any aggregates (also pandas ones) in the place of the summary."""
    return features.groupBy(*by, truncate(unit, F.col("ts")).alias("bucket")).agg(*aggregates)
