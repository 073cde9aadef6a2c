"""Readings of the uneven columns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the validation split.
VALIDATION = ("val", "dev", "valid", "validation")
# Names of languages.
LANGUAGES = {"en": "en", "eng": "en", "english": "en", "ar": "ar", "ara": "ar", "arabic": "ar", "mixed": "mixed", "mul": "mixed"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_name(c: str | Column) -> Column:
    """train, validation or test from a split in any letter case, blanks around it dropped; others as they are."""
    x = F.lower(F.trim(c))
    return F.when(x.isin(*VALIDATION), F.lit("validation")).when(x != "", x)


def source_name(c: str | Column) -> Column:
    """A source id in lower case without blanks around it; null if nothing is left."""
    x = F.lower(F.trim(c))
    return F.when(x != "", x)


def language_name(c: str | Column) -> Column:
    """One name for each language: the part before any region, by its usual code; unknown where there is none."""
    x = F.lower(F.trim(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1)))
    names = F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair])
    return F.when(c.isNull() if isinstance(c, Column) else F.col(c).isNull(), F.lit("unknown")).when(x == "", F.lit("unknown")).otherwise(F.coalesce(names[x], x))
