"""Folders for what a query writes on its way: shared by driver and executors, and gone when the application ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's, else (one machine only) a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="convoq-")
        atexit.register(shutil.rmtree, _local_dirs[sc.applicationId], ignore_errors=True)
    return _local_dirs[sc.applicationId]


def new_path(spark: SparkSession, what: str = "table") -> str:
    """An unused path in the shared folder; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/convoq-{what}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows (counted), else df itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
