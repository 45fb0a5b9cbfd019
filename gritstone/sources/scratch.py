"""The folder that all executors share, for tables that outlive a stage.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session that names
none gets a temporary one; on a cluster without the setting these functions refuse to guess. What an application has
put there goes when its driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_used: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """URI of this application's own folder inside the shared one."""
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
    if not base:
        if not local:
            raise ValueError(f"{_SETTING} is not set; it must name a folder that every executor can reach")
        base = "file://" + tempfile.mkdtemp(prefix="gritstone-")
        spark.conf.set(_SETTING, base)
    if "://" not in base and base.startswith("/") and local:
        base = "file://" + base
    folder = f"{base.rstrip('/')}/gritstone-{spark.sparkContext.applicationId}"
    _used.add(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear() -> None:
    """Remove the folders of this driver's applications; results must have been written elsewhere by then."""
    for folder in list(_used):
        try:
            if folder.startswith("file:"):
                shutil.rmtree("/" + folder.removeprefix("file:").lstrip("/"), ignore_errors=True)
            else:
                import pyarrow.fs as pafs

                fs, path = pafs.FileSystem.from_uri(folder)
                fs.delete_dir(path)
        except (OSError, ValueError):
            continue
        _used.discard(folder)
