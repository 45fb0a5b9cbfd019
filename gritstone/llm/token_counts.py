"""Token counts of documents in flat, unindexed token files, by a scan for separators.

A token file is an array of 16- or 32-bit ids; an end-of-document id follows each document. Nothing says
where documents begin, so files are cut into blocks of equal size and scanned in parallel: each block is
one vectorised search for the separator. Lengths inside a block are differences of neighbouring hits. A
block's first document may have begun in any block before it, so a prefix scan over the blocks of a file
(one row each) gives each block the number of documents before it and the tokens since the last separator.

Defined results for odd input: two separators in a row are a document of no tokens. Tokens after a file's
last separator are one more document; an empty file has none. A block without a separator just adds to
the next one. Files may be of any length, documents longer than any number of blocks. A file that ends within a token is
damaged, and refused with its name.

``write_token_files`` makes such files from a text column. A null text is written like an empty one.
Repeated rows are written one by one, and null ids are kept.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import codec, model_path
from .shared import arrow_map, fresh_path, open_fs, read_range, stored
from .text import slices

BLOCK_TOKENS = 4 << 20
_BLOCKS = "file string, block bigint, first bigint, n_separators bigint, last_separator bigint, lengths array<bigint>"


def write_token_files(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """One token file a partition in ``folder``, of 16-bit ids where the vocabulary allows it.

    Runs at once. Returns ``(file, ordinal, doc_id)``: which document is where. A task that is retried
    writes the same file anew and moves it into place as a whole.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        kind = np.uint16 if own.model.vocab_size() <= 1 << 16 else np.uint32
        end = own.model.eos_id()
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        fs, base = open_fs(folder)
        part, done = f"{base}/.{name}.{uuid.uuid4().hex[:8]}", 0
        out = None
        for batch in slices(batches, "text", 4 << 20):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(part)
            ids, off = own.encode(batch.column("text"))
            flat = np.empty(len(ids) + batch.num_rows, kind)
            ends = off[1:] + np.arange(batch.num_rows)
            inner = np.ones(len(flat), bool)
            inner[ends] = False
            flat[ends], flat[inner] = end, ids
            out.write(memoryview(flat).cast("B"))
            yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), pa.array(np.arange(done, done + batch.num_rows)), batch.column("doc_id")], ["file", "ordinal", "doc_id"])
            done += batch.num_rows
        own.forget()
        if out is not None:
            out.close()
            fs.move(part, f"{base}/{name}")

    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType()), docs.schema["doc_id"]])
    return stored(arrow_map(docs.select("doc_id", "text"), run, schema), "token-places")


def scan_block(tokens: np.ndarray, separator: int, first: int, last: bool) -> tuple[int, int, np.ndarray]:
    """Separators of a block, the position of its last one (-1: none), and the lengths of the documents that end in it.

    The first length counts from the block's start only. In a file's last block, tokens after the last
    separator count as a document.
    """
    at = np.flatnonzero(tokens == separator)
    lengths = np.diff(at, prepend=-1) - 1
    tail = len(tokens) - (at[-1] + 1 if len(at) else 0)
    if last and (tail or not len(at)):
        lengths = np.append(lengths, tail)
    return len(at), first + int(at[-1]) if len(at) else -1, lengths


def count_tokens(spark: SparkSession, folder: str, separator: int, bits: int = 16, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(file, ordinal, n_tokens)`` of each document in the token files (``*.bin``) of ``folder``."""
    fs, base = open_fs(folder)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    width = bits // 8
    kind = np.dtype(f"<u{width}")
    own = [f for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".bin") and not f.base_name.startswith(".")]
    if damaged := sorted(f.base_name for f in own if f.size % width):
        raise ValueError(f"token files that end within a token of {width} bytes: {', '.join(damaged[:5])}")
    files = [(os.path.basename(f.path), f.size // width) for f in own if f.size]
    blocks = max(1, sum(-(-n // block_tokens) for _, n in files))
    table = spark.createDataFrame(files, "file string, tokens bigint").select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] * block_tokens
                n = min(block_tokens, row["tokens"] - first)
                tokens = np.frombuffer(read_range(f"{folder}/{row['file']}", first * width, n * width), kind)
                n_sep, last_sep, lengths = scan_block(tokens, separator, first, first + n == row["tokens"])
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["block"]]), pa.array([first]), pa.array([n_sep]), pa.array([last_sep]), pa.array([lengths], pa.list_(pa.int64()))], ["file", "block", "first", "n_separators", "last_separator", "lengths"])

    scanned = arrow_map(table.repartition(min(blocks, 4096), "file", "block"), run, _BLOCKS)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = scanned.select(
        "file",
        "lengths",
        F.coalesce(F.sum("n_separators").over(before), F.lit(0)).alias("documents_before"),
        (F.col("first") - 1 - F.coalesce(F.max("last_separator").over(before), F.lit(-1))).alias("tokens_before"),
    )
    # A last block whose tail is empty and that has nothing carried in holds no further document.
    each = stitched.select("file", "documents_before", "tokens_before", F.posexplode("lengths").alias("k", "length"))
    return each.select("file", (F.col("documents_before") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("tokens_before")).otherwise(0)).alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document, as scanned from token files of the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "tokens")
    places = write_token_files(docs, folder)
    counts = count_tokens(spark, folder, codec(model_path()).model.eos_id())
    return places.hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
