"""Saving and loading the canonical tables, and how they are laid out.

Events lie in a directory a day, entities in one a type, so that time ranges and types prune files. Within a
directory rows are spread over shards by a hash of the document, and sorted by key, so that a filter on keys skips
row groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bucket_floor
from ..model import ATTRS_SCHEMA
from ..operators.changelog import DEFAULT_BUCKET
from ..operators.geo import with_zorder
from ..operators.lastn import DEFAULT_N, last_n
from ..operators.ranges import valid

EVENT_SHARDS, ENTITY_SHARDS = 181, 7


def shard(identity: Column, shards: int, number: Callable[[Column], Column] = F.xxhash64) -> Column:
    """The shard of a document; ``number`` says how an identity becomes a whole number."""
    return F.pmod(number(identity), F.lit(shards)).cast("int")


def digest_number(identity: Column) -> Column:
    """A whole number from the first 60 bits of the identity's MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(identity.cast("string")), 1, 15), 16, 10).cast("bigint")


def save_events(attrs: DataFrame, path: str, shards: int = EVENT_SHARDS, mode: str = "append", number: Callable[[Column], Column] = F.xxhash64) -> None:
    """Write event attributes by day; one shuffle puts each shard of a day into one file."""
    day = F.coalesce(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    rows = attrs.withColumn("day", day).repartition("day", shard(F.col("doc_id"), shards, number)).sortWithinPartitions("day", "key", "doc_id", "ord")
    rows.write.mode(mode).partitionBy("day").parquet(path)


def save_entities(attrs: DataFrame, path: str, shards: int = ENTITY_SHARDS, mode: str = "append") -> None:
    """Write entity attributes by type."""
    rows = attrs.withColumn("part_type", F.col("doc_type")).repartition("part_type", shard(F.col("doc_id"), shards)).sortWithinPartitions("part_type", "key", "doc_id", "ord")
    rows.write.mode(mode).partitionBy("part_type").parquet(path)


def load_attrs(spark: SparkSession, path: str) -> DataFrame:
    """What ``save_events`` or ``save_entities`` wrote."""
    t = spark.read.parquet(path)
    wanted = [c.split()[0] for c in ATTRS_SCHEMA.replace("map<string,string>", "map").split(", ")]
    return t.select(*wanted, *(c for c in ("day", "part_type") if c in t.columns))


def shard_splits(spark: SparkSession, start: str, stop: str, shards: int = EVENT_SHARDS) -> DataFrame:
    """``(day, shard)`` for every shard of every day from ``start`` until before ``stop``; of one day if the two are the same."""
    first, last = F.lit(start).cast("date"), F.date_sub(F.lit(stop).cast("date"), 1)
    days = spark.range(1).select(F.explode(F.sequence(first, F.greatest(first, last), F.expr("interval 1 day"))).alias("day"))
    return days.select("day", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))


def load_days(spark: SparkSession, path: str, first: str, last: str, types: Iterable[str] | None = None) -> DataFrame:
    """Attributes of the days from ``first`` to ``last``; other days' directories aren't read."""
    rows = load_attrs(spark, path).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows if types is None else rows.where(F.col("doc_type").isin(*sorted(types)))


def put_last_n(batch: DataFrame, path: str, n: int = DEFAULT_N, group: str = "grp", ts: str = "ts", id_: str = "id", slots: int = 64) -> None:
    """Add events to a table that keeps the newest ``n`` of each group, whatever order they arrive in.

    Groups are spread over ``slots`` directories; only those that the batch touches are read and written again, each as
    a whole. Putting the same batch twice changes nothing. A late event only pushes out older ones.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("slot", shard(F.col(group), slots))
    touched = [r.slot for r in rows.select("slot").distinct().collect()]
    if not touched:
        return
    if exists(spark, path):
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("slot").isin(*touched))
        rows = old.unionByName(rows)
    kept = last_n(rows.dropDuplicates([group, id_]), group, n, ts, id_).drop("rank")
    kept.repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)


def load_last_n(spark: SparkSession, path: str) -> DataFrame:
    """What ``put_last_n`` keeps."""
    return spark.read.parquet(path).drop("slot")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def put_temporal(events: DataFrame, path: str, group: str = "grp", ts: str = "ts") -> None:
    """Append events to a table that keeps all of them, by day, sorted by group and time, so a query reads its days and groups."""
    rows = events.withColumn("day", F.col(ts).cast("date")).repartition("day").sortWithinPartitions("day", group, ts)
    rows.write.mode("append").partitionBy("day").parquet(path)


def save_ranges(ranges: DataFrame, path: str) -> None:
    """Append intervals in order of their beginnings. One that ends before it begins is refused, and then nothing is written."""
    checked = F.when(valid(F.col("lo"), F.col("hi")), F.col("lo")).otherwise(F.raise_error(F.lit("an interval ends before it begins")))
    ranges.withColumn("lo", checked.cast(ranges.schema["lo"].dataType)).repartitionByRange("lo").sortWithinPartitions("lo").write.mode("append").parquet(path)


def save_points(points: DataFrame, path: str, bits: int = 16) -> None:
    """Append points in z-order, so that files and row groups hold neighbours."""
    with_zorder(points, bits).repartitionByRange("z").sortWithinPartitions("z").write.mode("append").parquet(path)


def put_changes(events: DataFrame, path: str, size_ms: int = DEFAULT_BUCKET) -> None:
    """Append hashed events ``(ts, hash, ...)`` to a change log, with the ``bucket`` each belongs to, by day."""
    rows = events.withColumn("bucket", bucket_floor(F.col("ts"), size_ms)).withColumn("day", F.col("ts").cast("date"))
    rows.repartition("day").sortWithinPartitions("day", "bucket").write.mode("append").partitionBy("day").parquet(path)


def save_grouped(table: DataFrame, path: str, group: str = "group") -> None:
    """Bulk output in one directory a group."""
    table.write.mode("overwrite").partitionBy(group).parquet(path)


def sub_binned(table: DataFrame, cuts: Iterable, bins: int, group: str, key: str) -> DataFrame:
    """Adds ``partition``: the place of the group among sorted ``cuts``, then a bin of the key's hash within it.

    A group that is no greater than a cut lies before it. The number of partitions is ``(len(cuts) + 1) * bins``.
    """
    ordered = sorted(cuts)
    place = sum((F.when(F.col(group) > F.lit(c), 1).otherwise(0) for c in ordered), F.lit(0))
    return table.withColumn("partition", (place * bins + shard(F.col(key), bins, digest_number)).cast("int"))


def range_partitioned(table: DataFrame, partitions: int, group: str, key: str) -> DataFrame:
    """Rows in ranges of (group, key), sorted within each; long ranges of one group are cut by key."""
    return table.repartitionByRange(partitions, group, key).sortWithinPartitions(group, key)


def flatten_json(table: DataFrame, column: str, schema: str, separator: str = "_$", typed: bool = False) -> DataFrame:
    """Leaves of a JSON column as ``(key, value)`` rows; names of nested objects are joined by ``separator``.

    ``schema`` is the column's type in DDL. Elements of an array share their key; nulls and missing fields
    give no row. All other columns are kept. ``typed`` adds ``vtype``: long, double, boolean or string.
    """
    from pyspark.sql import types as T

    leaf_type = "array<struct<key:string,value:string,vtype:string>>"

    def vtype(kind: T.DataType) -> str:
        return "boolean" if isinstance(kind, T.BooleanType) else "long" if isinstance(kind, T.IntegralType) else "double" if isinstance(kind, T.NumericType) else "string"

    def walk(value: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StructType):
            inner = [walk(value[f.name], f.dataType, f"{name}{separator}{f.name}" if name else f.name) for f in kind.fields]
            return F.concat(*inner) if inner else F.array().cast(leaf_type)
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.flatten(F.transform(value, lambda v: walk(v, kind.elementType, name))), F.array().cast(leaf_type))
        return F.when(value.isNotNull(), F.array(F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"), F.lit(vtype(kind)).alias("vtype")))).otherwise(F.array().cast(leaf_type))

    kind = T.DataType.fromDDL(schema)
    parsed = F.from_json(F.col(column), schema)
    rest = [c for c in table.columns if c != column]
    return table.select(*rest, F.explode(walk(parsed, kind, "")).alias("leaf")).select(*rest, "leaf.key", "leaf.value", *(["leaf.vtype"] if typed else []))


def expand_json(leaves: DataFrame, by: Iterable[str], separator: str = "_$") -> DataFrame:
    """Objects of one level from ``(key, value)`` rows; several values of a key become an array.

    Where there is a column ``vtype``, numbers and booleans are written as such, else every value is a string.
    """
    by = list(by)
    text = F.to_json(F.array("value"))
    text = F.substring(text, F.lit(2), F.length(text) - 2)
    shown = F.when(F.col("vtype").isin("long", "double", "boolean"), F.col("value")).otherwise(text) if "vtype" in leaves.columns else text
    quoted = F.array_sort(F.collect_list(shown))
    gathered = leaves.groupBy(*by, "key").agg(quoted.alias("values"))
    quoted = F.col("values")
    entry = F.concat(F.lit('"'), F.replace(F.col("key"), F.lit(separator), F.lit(".")), F.lit('":'), F.when(F.size("values") == 1, quoted[0]).otherwise(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))))
    return gathered.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("json"))
