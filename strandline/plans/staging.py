"""Intermediate tables that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a temporary folder, if all executors are on this machine; else an error, as each
    executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return (named or _own()).rstrip("/")


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: what follows starts from the files.

    The table is deleted by released, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> int:
    """Deletes all tables staged so far, when results that read them have been written; gives their number."""
    paths, _made[:] = list(_made), []
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return len(paths)


def dropped(df: DataFrame) -> None:
    """Deletes a staged table that a later one has replaced."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def checked(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A staged table, marked for broadcast only if it has no more than so many rows; beyond that a join shuffles."""
    return F.broadcast(df) if df.count() <= most else df
