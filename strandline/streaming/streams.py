"""Structured Streaming: resumable ingestion into a keyed table, counts in windows, sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.tables import latest
from strandline.plans.staging import shared_dir


def source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream, with the schema of the present ones; or one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return reader.option("pathGlobFilter", hadoop.getName()).parquet(str(hadoop.getParent().toString()))
    return reader.parquet(path)


def drained(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there and reads its result.

    Batches and progress go to the folder given: a later call with the same folder, also of another
    application, takes only files that are new since then, and reads the old batches with the new. Without
    one, a folder of this call's own under the shared folder. In complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    folder = (folder or f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}").rstrip("/")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def tumbling(events: DataFrame, time: str, width: str, *by: str) -> DataFrame:
    """Events and their value in windows of one width; works on streams and tables."""
    return events.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, time: str, gap: str, by: str) -> DataFrame:
    """Runs of a key's events with no longer pause than gap; works on streams with a watermark and tables."""
    return events.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).select(by, "first", "last", "n")


def ingest(stream: DataFrame, keys: list[str], order: str, name: str, folder: str | None = None) -> DataFrame:
    """The last row of each key after every batch of a stream: appended batches, merged when they are read."""
    return latest(drained(stream, name, folder=folder), keys, F.col(order))


def once(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key's first row; a key that comes again within the watermark is dropped."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
