"""Where intermediate tables go: a folder that every executor can reach."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import cache

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

#: Scratch tables of this process that are still there, in the order they were made.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one is made only where none is set, as in tests."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="echolot-")


def table_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; what is written there is deleted with its scope, or when the process ends."""
    path = f"{shared_dir(spark)}/echolot-{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def file_system(context: SparkContext, path: str):
    """Hadoop's file system of a path, and the path in it: what Spark can write can be deleted or renamed by it."""
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def delete(context: SparkContext, path: str) -> None:
    files, at = file_system(context, path)
    files.delete(at, True)


def clear(spark: SparkSession, since: int = 0) -> int:
    """Deletes the scratch tables made since a mark (the number of tables then), and returns how many; DataFrames over them can't be read any more."""
    gone = _made[since:]
    for path in gone:
        delete(spark.sparkContext, path)
    del _made[since:]
    return len(gone)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables that are made inside when it ends, also after an error; results have to be written or collected inside."""
    mark = len(_made)
    try:
        yield
    finally:
        clear(spark, mark)


@contextmanager
def persisted(rows: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """The rows, kept by executors until the end of the block (a lost executor's part is made again)."""
    held = rows.persist(level)
    try:
        yield held
    finally:
        held.unpersist()


@atexit.register
def _clear_at_exit() -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        for path in _made:
            with suppress(Py4JError, OSError):
                delete(context, path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are in the shared folder, so a lost executor costs a reread and not the lineage."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again; its files stay until its scope or the process ends."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
