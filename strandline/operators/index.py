"""A keyed index in Parquet, one partition for each identity of the pipeline that made its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.vectors import is_unit
from strandline.operators.tables import latest, upsert
from strandline.operators.validate import divided, errors, filled
from strandline.plans.staging import checked, staged
from strandline.sources.readers import exists, write_partitions


def identified(rows: DataFrame, key: str, identity: str) -> DataFrame:
    """Rows without an identity get one of their own, made from their key; others keep theirs."""
    own = F.concat(F.lit("legacy-unversioned:"), F.col(key).cast("string"))
    return rows.withColumn(identity, F.coalesce(F.when(filled(identity), F.col(identity)), own))


def accepted(rows: DataFrame, key: str, identity: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may be indexed, and the others with their errors: no key, no identity, no vector of length one."""
    checks = errors(("key is empty", F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")), ("identity is empty", filled(identity)), ("vector is not of length one", is_unit(vector)))
    good, bad = divided(rows.withColumn("errors", checks))
    return good.drop("errors"), bad


def save(rows: DataFrame, path: str, key: str, identity: str, vector: str, order: str) -> DataFrame:
    """Inserts or replaces rows by identity and key, the last by order; gives the rejected rows with their errors.

    Only partitions of identities among the rows are read, merged and replaced; repeating a call changes nothing.
    """
    good, bad = accepted(rows, key, identity, vector)
    spark = rows.sparkSession
    if exists(spark, path):
        # the partitions are pruned by the identities at run time
        old = spark.read.parquet(path).join(checked(staged(good.select(identity).distinct())), identity, "left_semi")
        merged = upsert(old, good, [identity, key], order)
    else:
        merged = latest(good, [identity, key], F.col(order))
    write_partitions(staged(merged), path, identity)
    return bad


def collection(spark: SparkSession, path: str, identity: str, value: str) -> DataFrame:
    """All rows of one identity: only its partition is read."""
    return spark.read.parquet(path).filter(F.col(identity) == value)


def looked_up(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """The indexed rows of the given keys, in one join however many they are."""
    return spark.read.parquet(path).join(keys.select(key).distinct(), key, "left_semi")


def compacted(spark: SparkSession, path: str, to: str, identity: str, value: str, live: DataFrame, key: str) -> None:
    """Writes an index with one identity's rows only, without those whose key is no longer live."""
    write_partitions(collection(spark, path, identity, value).join(live.select(key).distinct(), key, "left_semi"), to, identity)


def encoded(texts: DataFrame, text: str, held: DataFrame, encode: Callable[[Column], Column], version: str) -> DataFrame:
    """(text_hash, encoder, vector) of each different text: vectors that are held for this encoder are used
    again, others are made. Null texts have none."""
    wanted = texts.filter(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.first(text).alias("_text"))
    known = held.filter(F.col("encoder") == version).join(wanted.select("text_hash"), "text_hash", "left_semi").select("text_hash", "encoder", "vector")
    new = wanted.join(known.select("text_hash"), "text_hash", "left_anti").select("text_hash", F.lit(version).alias("encoder"), encode(F.col("_text")).alias("vector"))
    return known.unionByName(new)


def letter_counts(dims: int = 32) -> Callable[[Column], Column]:
    """A stand-in for an encoder: counts of letters by their code modulo the dimensions, at length one."""
    from strandline.functions.text import let
    from strandline.functions.vectors import unit

    def encode(text: Column) -> Column:
        codes = lambda t: F.transform(F.filter(F.split(F.lower(t), ""), lambda c: c != ""), lambda c: F.ascii(c) % dims)
        counts = lambda held: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(held, lambda c: c == i)).cast("double"))
        return let(let(codes(text), counts), unit)

    return encode
