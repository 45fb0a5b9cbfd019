from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gritstone.operators import features, lastn
from gritstone.sources import tables
from gritstone.streaming import continuous

SCHEMA = "grp string, type string, name string, vis string, ts timestamp_ntz, value long, id long, hash string"


def write(spark, path, start, n):
    rows = [(f"g{i % 3}", "t", "n", "", datetime(2024, 1, 1) + timedelta(minutes=7 * i), i, i, f"h{i}") for i in range(start, start + n)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_rollup_and_hashes_agree_with_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, 0, 40)
    batch = spark.read.schema(SCHEMA).parquet(path)
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    got = run(spark, continuous.continuous_rollup(stream, "HOURS", "1 day"), "rolled", "update")
    want = features.rollup(batch, "HOURS").select(*got.columns)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    hashes = run(spark, continuous.continuous_change_hashes(stream, "1 hour", "1 minute"), "hashed", "append")
    assert hashes.count() >= 1
    assert run(spark, continuous.aged_off(stream, "1 day"), "aged", "append").count() == 0


def test_last_n_keeps_late_events(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for start, n in ((20, 20), (0, 20)):
        write(spark, path, start, n)
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        continuous.keep_last_n(stream, out, 5, "grp", "ts", "id", str(tmp_path / "cp")).awaitTermination()
        got = tables.load_last_n(spark, out)
    want = lastn.last_n(spark.read.parquet(path), "grp", 5).drop("rank")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    assert got.agg(F.max("id")).first()[0] == 39
