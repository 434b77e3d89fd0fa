"""Where intermediate tables and streaming state are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Frees the shuffle files of a finished write; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that Spark hands to Python; by rows alone, 10,000 whole texts would be one.
ARROW, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may leave it unset; it then
    gets a fresh local folder. On a cluster every machine would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return _local_dir()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Writes in this block free the shuffle files behind them when they end, and hand rows to Python in small batches."""
    wanted = {CLEANUP: "true", ARROW: ARROW_BYTES}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For an expensive plan with several readers; it also ends the lineage, so the shuffle
    files behind it are freed.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with freeing(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for table in tables:
        remove(table.sparkSession, table.scratch)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever file system it is on; it may be missing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared storage, none if it is missing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [found.getPath().getName() for found in system.listStatus(folder)] if system.exists(folder) else []
