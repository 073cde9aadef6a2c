"""Readers and writers of the formats that the pipeline's inputs come in."""

from __future__ import annotations

import hashlib
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON file that is one array or object; a byte-order mark is skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. Strict: a bad line fails the job. Else bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of lines that are neither blank nor JSON; lines are counted from 1.

    Files are read whole, one a row, so that a line knows its number: for files that fit into a task.
    """
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)
    return lines.filter(F.trim("value") != "").filter(F.expr("try_parse_json(value) is null"))


def read_articles(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines or JSON by the name's ending."""
    return read_jsonl(spark, path, schema) if path.rstrip("/").endswith(".jsonl") else read_json(spark, path, schema)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, or no rows where the path does not exist."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, path, schema, strict=False)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-separated members with a heading."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, revision_id, timestamp, wikitext) of a wiki dump, compressed or not."""
    schema = "id STRING, title STRING, revision STRUCT<id: STRING, timestamp: STRING, text: STRUCT<_VALUE: STRING>>"
    pages = spark.read.format("xml").option("rowTag", "page").option("valueTag", "_VALUE").schema(schema).load(path)
    return pages.select(F.col("id").alias("page_id"), "title", F.col("revision.id").alias("revision_id"), F.col("revision.timestamp").alias("timestamp"), F.col("revision.text._VALUE").alias("wikitext"))


def manifests(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """JSON documents of a path pattern with the file each came from."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file", F.col("_metadata.file_path"))


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replaces just the partitions that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, in place of what is there or behind it; either takes effect as a whole."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_provenance(df: DataFrame, path: str, text: str, provenance: list[str]) -> None:
    """JSON lines of a text with where it came from as a nested object."""
    df.select(*[c for c in df.columns if c not in provenance], F.struct(*provenance).alias("provenance")).filter(F.col(text).isNotNull()).write.mode("overwrite").json(path)


def content_digest(df: DataFrame) -> str:
    """A digest of all rows, whatever their order: sums of pieces of each row's SHA-256, combined on the way."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(df.columns)])), 256)
    pieces = df.select(row.alias("r")).agg(F.count(F.lit(1)), *[F.sum(F.conv(F.substring("r", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(4)]).first()
    return hashlib.sha256("-".join(map(str, pieces)).encode()).hexdigest()


def write_versioned(df: DataFrame, folder: str) -> str:
    """Writes a dataset under the digest of its content and gives the path; one that is there already stays."""
    path = f"{folder.rstrip('/')}/{content_digest(df)}"
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return path


def write_once(df: DataFrame, path: str) -> bool:
    """Writes a dataset where there is none; the same content may be written again, other content is an error."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
        return True
    if content_digest(spark.read.parquet(path)) != content_digest(df):
        raise ValueError(f"{path} holds other content")
    return False


def log_change(path: str, before: DataFrame, after: DataFrame, key: str) -> None:
    """Appends to an event log the keys whose row changed, came or went: (key, before_hash, after_hash, logged_at)."""
    digest = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key))), 256).alias(name))
    both = digest(before, "before_hash").join(digest(after, "after_hash"), key, "full").filter(~F.col("before_hash").eqNullSafe(F.col("after_hash")))
    both.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def archive_members(spark: SparkSession, path: str, ending: str, schema: StructType | str, sep: str = "\t") -> DataFrame:
    """The rows of all separated members of zip archives with a heading, with archive and member: a task reads
    an archive, which cannot be divided, member by member and line by line."""

    def members(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in sorted(n for n in z.namelist() if n.endswith(ending)):
                        lines = io.TextIOWrapper(z.open(m), "utf-8-sig").read().splitlines()
                        columns = [[name] * len(lines[1:]), [m] * len(lines[1:]), lines[1:]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["archive", "member", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(members, "archive string, member string, line string")
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return rows.select("archive", "member", F.from_csv("line", ddl, {"sep": sep, "quote": ""}).alias("r")).select("archive", "member", "r.*")


def grouped_mentions(mentions: DataFrame, document: str) -> DataFrame:
    """(document, mentions): each document's mentions as an array of structs, in the order of their columns."""
    rest = [c for c in mentions.columns if c != document]
    return mentions.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("mentions"))


def described_pages(pages: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Pages with their descriptors, joined on page and revision: what describes another revision is left out."""
    return pages.join(descriptors, ["page_id", "revision_id"])
