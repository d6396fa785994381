"""Durable intermediate results, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_folders: list[tuple[SparkSession, str]] = []
#: Where the table of a frame lies, as long as somebody has the frame.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can read: the cluster's, or one of our own where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("executors share no folder of this machine: set spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="kerbside-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage and outlives executors."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _paths[kept] = path
    return kept


def discard(*tables: DataFrame, shuffles: bool = False) -> None:
    """Deletes what ``materialize`` has written for these. Only for tables of which everything made from them is written itself.

    ``shuffles``: and shuffle files that nobody refers to any more. Spark removes the files of a shuffle when the driver's collector finds that nothing refers to it; a driver with much memory does so late,
    when the executors' disks hold the shuffles of many steps."""
    for kept in tables:
        path = _paths.pop(kept, None)
        if path is not None:
            _remove(kept.sparkSession, path)
            _folders.remove((kept.sparkSession, path))
    if shuffles:
        for context in {kept.sparkSession.sparkContext for kept in tables}:
            context._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_folders() -> None:
    for spark, path in _folders:
        if spark.sparkContext._jsc is None or spark.sparkContext._jvm is None:
            return
        _remove(spark, path)
