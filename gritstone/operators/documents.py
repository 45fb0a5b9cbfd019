"""Event and entity queries over the long attribute table, and the catalogue derived from it.

All of them see what the caller may see: visibility and expiration are filtered before anything else, so an
attribute that is hidden or dead neither matches a predicate nor comes back.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.visibility import unexpired, visible
from ..model import IDENTITY, VALUE_COLUMNS, to_docs
from ..plans.criteria import literal, matching_ids


def readable(attrs: DataFrame, auths: Iterable[str] | None = None, now_ms: int | None = None) -> DataFrame:
    """Attributes that the authorisations allow (all, if None) and that are alive at ``now_ms`` (not asked, if None)."""
    if auths is not None:
        attrs = visible(attrs, auths)
    return attrs if now_ms is None else attrs.where(unexpired(now_ms, F.col("ts"), F.col("expiration")))


def between(attrs: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Documents of a time range, both ends included."""
    if start is not None:
        attrs = attrs.where(F.col("ts") >= literal(start))
    return attrs if end is None else attrs.where(F.col("ts") <= literal(end))


def select_fields(attrs: DataFrame, fields: Iterable[str] | None) -> DataFrame:
    """Only attributes of the given keys; None is all. Documents left without attributes are not in the result."""
    return attrs if fields is None else attrs.where(F.col("key").isin(*sorted(fields)))


def query(attrs: DataFrame, node, types: Iterable[str] | None = None, start: datetime | None = None, end: datetime | None = None, fields: Iterable[str] | None = None, auths: Iterable[str] | None = None, now_ms: int | None = None) -> DataFrame:
    """Attributes of the documents that match. An empty criteria tree finds nothing."""
    own = between(readable(attrs, auths, now_ms), start, end)
    if types is not None:
        own = own.where(F.col("doc_type").isin(*sorted(types)))
    ids = matching_ids(own, node)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"i.{c}")) for c in IDENTITY]
    return select_fields(own.alias("a").join(ids.alias("i"), same, "left_semi"), fields)


def get(attrs: DataFrame, ids: DataFrame, fields: Iterable[str] | None = None, auths: Iterable[str] | None = None, now_ms: int | None = None) -> DataFrame:
    """Attributes of the documents named in ``ids(doc_type, doc_id)``. Spark broadcasts the ids if they are few."""
    return select_fields(readable(attrs, auths, now_ms).join(ids.select("doc_type", "doc_id").distinct(), ["doc_type", "doc_id"], "left_semi"), fields)


def get_all_by_type(attrs: DataFrame, types: Iterable[str], start: datetime | None = None, end: datetime | None = None, fields: Iterable[str] | None = None, auths: Iterable[str] | None = None, now_ms: int | None = None) -> DataFrame:
    """Attributes of all documents of the types."""
    return select_fields(between(readable(attrs, auths, now_ms), start, end).where(F.col("doc_type").isin(*sorted(types))), fields)


def documents(attrs: DataFrame) -> DataFrame:
    """The documents of attribute rows, each with an array of attributes; such without attributes don't exist."""
    return to_docs(attrs).where(F.size("attrs") > 0)


def types(attrs: DataFrame, prefix: str = "") -> DataFrame:
    """Distinct document types; visibility plays no part in this."""
    return attrs.where(F.col("doc_type").startswith(prefix)).select("doc_type").distinct()


def unique_keys(attrs: DataFrame, doc_type: str, prefix: str = "", auths: Iterable[str] | None = None) -> DataFrame:
    """Distinct keys of a type, with the types of their values."""
    return readable(attrs, auths).where((F.col("doc_type") == doc_type) & F.col("key").startswith(prefix)).select("key", "vtype").distinct()


def value_text() -> Column:
    """An attribute's value as text, whatever its type."""
    return F.coalesce(*(F.col(c).cast("string") for c in VALUE_COLUMNS.values()))


def unique_values(attrs: DataFrame, doc_type: str, key: str, vtype: str, prefix: str = "", auths: Iterable[str] | None = None) -> DataFrame:
    """Distinct values of one key and value type, as text, by prefix of the text."""
    rows = readable(attrs, auths).where((F.col("doc_type") == doc_type) & (F.col("key") == key) & (F.col("vtype") == vtype))
    return rows.select(F.col(VALUE_COLUMNS[vtype]).cast("string").alias("value")).where(F.col("value").startswith(prefix)).distinct()


def merged_expiration(expiration: Column) -> Column:
    """Expiration of an index entry: never (-1) if any of its attributes never expires, else the longest."""
    return F.when(F.bool_or(expiration == -1), F.lit(-1)).otherwise(F.greatest(F.lit(0), F.max(expiration))).cast("bigint")


def index_cardinality(attrs: DataFrame, by: Iterable[str] = ("doc_type", "key", "vtype")) -> DataFrame:
    """Attribute counts and expirations by type, key, value type or whatever is asked for; partial sums on the map side."""
    return attrs.groupBy(*by).agg(F.count("*").alias("cardinality"), merged_expiration(F.col("expiration")).alias("expiration"))


def merge_cardinality(entries: DataFrame, by: Iterable[str]) -> DataFrame:
    """Index entries of several batches as one: cardinalities add up."""
    return entries.groupBy(*by).agg(F.sum("cardinality").alias("cardinality"), merged_expiration(F.col("expiration")).alias("expiration"))


def delete(attrs: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left without the documents named in ``ids(doc_type, doc_id)``."""
    return attrs.join(ids.select("doc_type", "doc_id").distinct(), ["doc_type", "doc_id"], "left_anti")
