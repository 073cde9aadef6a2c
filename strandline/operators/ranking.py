"""Ranking of records against written interests and structured filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import word_key, words
from strandline.plans.staging import checked, staged


def long_tags(df: DataFrame, key: str, tags: Column) -> DataFrame:
    """A map of category to names as rows (key, category, value, norm); null and blank names are left out."""
    rows = df.select(F.col(key), F.explode(tags).alias("category", "values")).select(key, "category", F.explode("values").alias("value"))
    return rows.withColumn("norm", word_key("value")).filter("norm <> ''")


def tfidf(queries: DataFrame, records: DataFrame, query_key: str, query_text: str, key: str, text: str) -> DataFrame:
    """Cosine of each query with each record that shares a term: (query_key, key, similarity).

    Terms are lower-case words of two or more characters, weights tf * (ln((1 + N) / (1 + df)) + 1). Each
    query is fitted together with the records, so N counts it and its own terms have one more df; record
    norms are corrected for that from the shared terms alone. Null texts have no terms.
    """
    # texts are divided into words once: all sums below read this table
    terms = staged(records.select(F.col(key), F.explode(words(text, 2)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))
    total = records.select(F.count(F.lit(1)).alias("n"))
    df = staged(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = lambda d: F.log((F.col("n") + 2) / (d + 1)) + 1
    weighed = terms.join(df, "term").crossJoin(F.broadcast(total))
    norms = weighed.groupBy(key).agg(F.sum(F.pow(F.col("tf") * idf(F.col("df")), 2)).alias("base"))
    asked = queries.select(F.col(query_key), F.explode(words(query_text, 2)).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("qtf"))
    fitted = staged(asked.join(df, "term", "left").crossJoin(F.broadcast(total)).withColumn("idf", idf(F.coalesce("df", F.lit(0)) + 1)))
    lengths = fitted.groupBy(query_key).agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("idf"), 2))).alias("query_norm"))
    shared = (
        terms.join(checked(fitted), "term")
        .groupBy(query_key, key)
        .agg(
            F.sum(F.col("tf") * F.col("qtf") * F.pow("idf", F.lit(2))).alias("product"),
            F.sum(F.pow("tf", F.lit(2)) * (F.pow("idf", F.lit(2)) - F.pow(idf(F.col("df")), F.lit(2)))).alias("change"),
        )
    )
    return shared.join(norms, key).join(lengths, query_key).select(query_key, key, (F.col("product") / (F.sqrt(F.col("base") + F.col("change")) * F.col("query_norm"))).alias("similarity"))


def filter_coverage(required: DataFrame, tags: DataFrame, query_key: str, key: str) -> DataFrame:
    """How far each record meets each query's required names, for records that meet at least one.

    required, tags: rows of long_tags. Names count as alternatives inside a category, categories as
    conditions: coverage is the share of the query's categories in which some name matches, direct means all.
    """
    active = required.groupBy(query_key).agg(F.count_distinct("category").alias("active"))
    want = required.select(query_key, "category", "norm").distinct()
    have = tags.select(key, "category", "norm").distinct()
    met = have.join(want, ["category", "norm"]).groupBy(query_key, key).agg(F.count_distinct("category").alias("satisfied"), F.count(F.lit(1)).alias("matched"))
    return met.join(active, query_key).select(query_key, key, "active", "satisfied", "matched", (F.col("satisfied") / F.col("active")).alias("coverage"), (F.col("satisfied") == F.col("active")).alias("direct"))


def hybrid(similarities: DataFrame, coverage: DataFrame, active: DataFrame, query_key: str, key: str, weight: float = 0.75, limit: int = 10) -> DataFrame:
    """The best records of each query: direct matches first, then score, then key, all descending.

    With active filters the score is weight * similarity + (1 - weight) * coverage, else the similarity;
    it is rounded before it is ordered. Records of neither similarity nor coverage score 0 and are not listed.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit is not from 1 to 100")
    both = similarities.join(coverage.select(query_key, key, "coverage", "direct"), [query_key, key], "full").join(active.select(query_key, F.lit(True).alias("filtered")).distinct(), query_key, "left")
    sim, cov = F.coalesce("similarity", F.lit(0.0)), F.coalesce("coverage", F.lit(0.0))
    score = F.round(F.when(F.col("filtered"), weight * sim + (1 - weight) * cov).otherwise(sim), 5)
    scored = both.select(query_key, key, score.alias("score"), F.coalesce("direct", F.lit(False)).alias("direct"), F.round(cov, 5).alias("coverage"))
    return best(scored, [query_key], [F.desc("direct"), F.desc("score"), F.desc(key)], limit)


def best(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first rows of each group with their rank; groups are cut before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= limit)
