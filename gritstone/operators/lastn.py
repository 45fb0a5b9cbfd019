"""The newest events of groups."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.criteria import literal

DEFAULT_N = 100


def last_n(events: DataFrame, group: str, n: int = DEFAULT_N, ts: str = "ts", id_: str = "id") -> DataFrame:
    """The newest ``n`` events of each group with their ``rank``; equal times go by id. Spark limits groups before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col(ts).desc(), F.col(id_).asc())
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def temporal_last_n(events: DataFrame, groups: Iterable, start: datetime, stop: datetime, n: int, group: str = "grp", ts: str = "ts", id_: str = "id") -> DataFrame:
    """The newest ``n`` events of a set of groups together, within a time range with both ends, newest first."""
    own = events.where(F.col(group).isin(*groups) & (F.col(ts) >= literal(start)) & (F.col(ts) <= literal(stop)))
    return own.orderBy(F.col(ts).desc(), F.col(id_).asc()).limit(n)
