"""Similar names and phrases, to explain why a record was ranked: joins on features, never of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import col, let
from strandline.operators.linking import letter_runs
from strandline.operators.ranking import best
from strandline.plans.staging import staged

# Words that no phrase begins or ends with.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "follow", "monitor", "track",
    "عن", "في", "على", "إلى", "الى", "من", "مع", "و", "أو", "او", "هذا", "هذه", "التي", "الذي",
)
# Fixed value: a word of a phrase.
PHRASE_WORD = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"


def letter_vectors(values: DataFrame, value: str) -> DataFrame:
    """(value, feature, weight): each distinct text as a vector of length one over its runs of three characters.

    What any encoder gives can stand in its place, one row for each number of a vector that is not 0.
    """
    return values.select(F.col(value).alias("value")).distinct().withColumn("runs", letter_runs("value")).select("value", F.explode("runs").alias("feature"), (1 / F.sqrt(F.size("runs"))).alias("weight"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity): texts of two sets of vectors whose product is at least so much, to 5 places.

    They meet on equal features, whose products are added up before and after the shuffle.
    """
    a, b = left.select(F.col("value").alias("a"), "feature", F.col("weight").alias("wa")), right.select(F.col("value").alias("b"), "feature", F.col("weight").alias("wb"))
    products = a.join(b, "feature").groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 5).alias("similarity"))
    return products.filter(F.col("similarity") >= least)


def related_tags(wants: DataFrame, tags: DataFrame, query_key: str, key: str, least: float = 0.45, top: int = 3) -> DataFrame:
    """(query_key, key, interest, tag, similarity, rank): the most similar different names of a query and a record.

    wants, tags: rows of long_tags. Names that both have in one category explain themselves and are left out;
    a pair of names counts once, whatever its categories. Ties go to the smaller names.
    """
    exact = tags.join(wants, ["category", "norm"]).select(query_key, key, "norm").distinct()
    w, t = wants.select(query_key, F.col("norm").alias("interest")).distinct(), tags.select(key, F.col("norm").alias("tag")).distinct()
    alike = staged(similar_pairs(letter_vectors(w, "interest"), letter_vectors(t, "tag"), least))
    pairs = alike.select(F.col("a").alias("interest"), F.col("b").alias("tag"), "similarity").join(w, "interest").join(t, "tag")
    for side in ("interest", "tag"):
        pairs = pairs.join(exact.withColumnRenamed("norm", side), [query_key, key, side], "left_anti")
    return best(pairs, [query_key, key], [F.desc("similarity"), F.asc("interest"), F.asc("tag")], top).select(query_key, key, "interest", "tag", "similarity", "rank")


def phrases(text: str | Column, most: int = 48, longest: int = 2) -> Column:
    """The phrases by which a text is explained: structs of phrase, first word and number of words.

    Runs of one and two words among the first so many, single ones first; longer ones neither begin nor end
    with a stop word, and each has a word of content, of more than one letter. Of equal phrases the first
    stays. Null for null.
    """
    found = F.slice(F.regexp_extract_all(col(text), F.lit(PHRASE_WORD), F.lit(0)), 1, most)
    stop = lambda w: F.lower(w).isin(*STOP_WORDS)

    def runs(words: Column, n: int) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(i.cast("int").alias("first"), F.slice(words, i + 1, F.lit(n)).alias("w")))
        kept = F.filter(whole, lambda r: F.exists(r["w"], lambda w: ~stop(w) & (F.length(w) > 1)) & ((~stop(r["w"][0]) & ~stop(F.element_at(r["w"], -1))) if n > 1 else F.lit(True)))
        named = F.transform(kept, lambda r: F.struct(F.array_join(r["w"], " ").alias("phrase"), r["first"].alias("first"), F.lit(n).alias("n")))
        return F.when(F.size(words) >= n, named).otherwise(F.array().cast("array<struct<phrase:string,first:int,n:int>>"))

    def fresh(every: Column) -> Column:
        keys = F.transform(every, lambda r: F.lower(r["phrase"]))
        return let(keys, lambda keys: F.filter(every, lambda r, i: F.array_position(keys, F.lower(r["phrase"])) == i + 1))

    return F.when(col(text).isNotNull(), let(found, lambda words: let(F.concat(*[runs(words, n) for n in range(1, longest + 1)]), fresh)))


def related_phrases(queries: DataFrame, records: DataFrame, query_key: str, query_text: str, key: str, text: str, least: float = 0.55, top: int = 3) -> DataFrame:
    """(query_key, key, query_phrase, phrase, similarity, rank): pairs of phrases of a query and of a record.

    The most similar pair is taken first, longer phrases a little before shorter ones, then those that share
    no word with a pair that was taken, as many as asked for.
    """
    a = staged(queries.select(query_key, F.explode(phrases(query_text)).alias("p")).select(query_key, F.lower("p.phrase").alias("a"), F.col("p.phrase").alias("pa"), F.col("p.first").alias("fa"), F.col("p.n").alias("na")))
    b = staged(records.select(key, F.explode(phrases(text)).alias("p")).select(key, F.lower("p.phrase").alias("b"), F.col("p.phrase").alias("pb"), F.col("p.first").alias("fb"), F.col("p.n").alias("nb")))
    alike = staged(similar_pairs(letter_vectors(a, "a"), letter_vectors(b, "b"), least))
    met = alike.join(a, "a").join(b, "b").withColumn("score", F.round(F.col("similarity") + 0.002 * (F.col("na") + F.col("nb") - 2), 5))
    ordered = F.struct((-F.col("score")).alias("score"), "na", "fa", "nb", "fb", "pa", "pb", "similarity")
    lists = met.groupBy(query_key, key).agg(F.array_sort(F.collect_list(ordered)).alias("found"))
    apart = lambda x, y: ((x["fa"] + x["na"] <= y["fa"]) | (y["fa"] + y["na"] <= x["fa"])) & ((x["fb"] + x["nb"] <= y["fb"]) | (y["fb"] + y["nb"] <= x["fb"]))
    taken = F.aggregate("found", F.slice("found", 1, 0), lambda done, x: F.when((F.size(done) < top) & ~F.exists(done, lambda y: ~apart(x, y)), F.concat(done, F.array(x))).otherwise(done))
    return lists.select(query_key, key, F.posexplode(taken).alias("pos", "t")).select(query_key, key, F.col("t.pa").alias("query_phrase"), F.col("t.pb").alias("phrase"), "t.similarity", (F.col("pos") + 1).alias("rank"))


def whole_score(similarity: Column, coverage: Column) -> Column:
    """Similarity and coverage from 0 to 100, three quarters to one, rounded half to even at each step."""
    return F.bround(0.75 * percent(similarity) + 0.25 * percent(coverage), 0).cast("int")


def percent(share: Column) -> Column:
    """A share as a whole number from 0 to 100, rounded half to even."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(share * 100, 0).cast("int")))


def reasons(exact: Column, similarity: Column, related: Column) -> Column:
    """At most five reasons: three exact names, the similarity, two related names."""
    return F.slice(F.concat(F.slice(exact, 1, 3), F.array(similarity), F.slice(related, 1, 2)), 1, 5)


def stable_rank(df: DataFrame, by: str, order: list[Column], position: str, limit: int) -> DataFrame:
    """The first rows of each group; rows that are equal in the order keep that of their positions."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is not from 1 to 100")
    return best(df, [by], [*order, F.asc(position)], limit)


def restricted(ranked: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Only the wanted keys; an error if one of them is not among the rows."""
    missing = wanted.select(key).distinct().join(ranked.select(key).distinct(), key, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no row for {missing[0][0]!r}")
    return ranked.join(wanted.select(key).distinct(), key, "left_semi")


def scored_above(ranked: DataFrame, score: str, least: float) -> DataFrame:
    """The rows of at least this score; a null score is below any."""
    return ranked.filter(F.col(score) >= least)
