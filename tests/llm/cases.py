"""Tables with every oddity, for all operators."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
HUGE_WORD = "ab" * 200_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], SCHEMA)


def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids."""
    rows = [(1, None), (2, ""), (3, "   \n\n\t"), (4, LONG), (5, HUGE_WORD), (6, "one"), (6, "one"), (None, "no id here at all, none"), (None, None), (7, "Éİx \U0001f600 ▁ z\n\n"), (8, "a\x00b ﻿ c")]
    return docs(spark, rows)


def empty(spark):
    return docs(spark, [])


def clashing(table):
    """The same with columns named like inner ones of the operators."""
    for name in ("n", "key", "doc", "lane0", "owner", "label", "gone", "row", "a", "b", "root", "node", "score", "unit", "x", "shard", "begin", "__doc"):
        table = table.withColumn(name, F.lit(name))
    return table
