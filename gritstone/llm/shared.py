"""Files in the folder that all executors share, Python over Arrow batches, and the package's way to the workers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.scratch import fresh_path, shared_folder, stored

__all__ = ["arrow_map", "fresh_path", "integer_ids", "open_fs", "read_file", "read_range", "shared_folder", "ship_package", "stored", "write_file"]


def integer_ids(df: DataFrame, column: str) -> None:
    """Refuse a table whose ids aren't integers: operators that rank or link rows hold ids as 64-bit numbers."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{column} must be of an integer type, not {kind.simpleString()}; map other ids to numbers first")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI, for use inside tasks."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, payload: bytes | memoryview) -> None:
    """Write a whole file under a temporary name, then move it: a task that is retried does no harm."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(part) as out:
        out.write(payload)
    fs.move(part, path)


def read_range(uri: str, start: int, length: int) -> memoryview:
    """Bytes ``[start, start + length)`` of a file."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return memoryview(f.read_at(length, start))


def read_file(uri: str) -> memoryview:
    """A whole file; mapped into memory where the file is a local one."""
    fs, path = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return memoryview(f.read_buffer())
    with fs.open_input_file(path) as f:
        return memoryview(f.read())


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow``, with this package sent to the executors first: their Python path need not hold it.

    Documents are long, so batches are kept at 2,048 rows, unless the session says otherwise. Memory that
    a task has used goes back to the system when it ends, for workers live on.
    """
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "2048")

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from function(batches)
        finally:
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package's sources to Spark, which serves them to every worker; once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="gritstone-sources-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
