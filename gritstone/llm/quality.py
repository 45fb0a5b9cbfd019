"""Quality classifier: an additive model of text statistics, scored by adding lookup-table cells.

The statistics of a slice of documents are computed at once on its bytes; scoring is one table lookup for
each feature and each chosen pair. The model is fitted on the driver, on the statistics of at most
``MAX_LABELLED`` labelled documents, picked by a hash of ``doc_id`` so that the choice is the same
everywhere. All documents are scored, on whole texts, in one pass without a shuffle.

Defined results for odd input: null and empty texts have no words and get the model's score for that;
as there are no words to judge by, they are rejected. Labels that are null don't count, and a ``doc_id``
with several labels has the lowest. Without labels, or with one class only, everything with a word is
kept (or, if all labels are 0, rejected). Repeated rows score alike; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .gam import Gam, fit
from .shared import arrow_map
from .text import lowered, slices, text_buffer, words

MAX_LABELLED = 20_000
FEATURES = ("words", "word_length", "symbols", "pipes", "marks", "capitals", "digits", "repeats", "loops", "short_words", "line_words", "sentence_words", "wide_letters")
_CLASS = np.zeros(256, np.uint8)
for _k, _codes in enumerate((b" \t\r", b"\n", b"|", b"!?", b".", b"%$&#*@^~<>{}[]_+=\\/", b"0123456789", range(65, 91), range(97, 123), range(128, 256))):
    _CLASS[list(_codes)] = _k + 1


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    raw, off = text_buffer(column)
    rows = len(off) - 1
    size = np.diff(off)
    held = np.flatnonzero(size)
    counts = np.zeros((rows, 12), np.int64)
    if len(held):
        kind = _CLASS[raw]
        for k in range(1, 11):
            counts[held, k] = np.add.reduceat(kind == k, off[:-1][held], dtype=np.int64)
    buf, off = text_buffer(lowered(column))
    w = words(buf, off)
    n = np.diff(w.first)
    row = w.row
    same = np.zeros(rows, np.int64)
    loop = np.zeros(rows, np.int64)
    for lag, into in ((1, same), (2, loop)):
        if len(row) > lag:
            hit = (w.hash[lag:] == w.hash[:-lag]) & (row[lag:] == row[:-lag])
            into += np.bincount(row[lag:][hit], minlength=rows)
    length = w.end - w.start
    some = np.maximum(n, 1)
    chars = np.maximum(size, 1)
    letters = np.maximum(counts[:, 8] + counts[:, 9], 1)
    return np.column_stack([
        np.log1p(n),
        np.bincount(row, length, rows) / some,
        counts[:, 6] / chars,
        counts[:, 3] / some,
        counts[:, 4] / some,
        counts[:, 8] / letters,
        counts[:, 7] / chars,
        same / some,
        loop / some,
        np.bincount(row[length <= 3], minlength=rows) / some,
        n / (counts[:, 2] + 1),
        n / (counts[:, 5] + 1),
        counts[:, 10] / chars,
    ])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **settings) -> Gam:
    """Fit to ``labels(doc_id, quality)``; at most about ``max_labelled`` of them, and all if there are no more."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    share = max_labelled / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # The sample's size is bounded by the parameter, whatever the size of the tables.
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    t = arrow_map(sample, _describe, schema).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(t["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = t["label"].to_numpy()
    # Rows in an order that has nothing to do with ids, the same on every run.
    order = np.random.default_rng(104_729).permutation(len(x))
    return fit(x[order], y[order], FEATURES, **settings)


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """``docs`` with ``quality_score`` (a probability) and ``keep``; columns of these names are replaced."""
    docs = docs.drop("quality_score", "keep")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(batch.column("text"))
            p = held.value.probability(x)
            keep = (p >= held.value.threshold) & (x[:, 0] > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(keep)], [*batch.schema.names, "quality_score", "keep"])

    return arrow_map(docs, run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents the classifier keeps, all columns as they were."""
    model = train(docs, labels, **settings)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(batch.column("text"))
            yield batch.filter(pa.array((held.value.probability(x) >= held.value.threshold) & (x[:, 0] > 0)))

    return arrow_map(docs, run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the classifier keeps, with its score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where("keep").select("doc_id", "quality_score")
