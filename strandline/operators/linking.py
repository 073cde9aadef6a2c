"""Names in text: catalogue phrases, literal places, and links to entities."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandline.functions.text import col, first_offset, let, occurrences, word_key, words
from strandline.operators.ranking import best

# The label category of each entity type.
CATEGORIES = {"country": "countries", "company": "companies", "organization": "organizations", "profile": "profiles", "system": "systems", "topic": "topics"}
# Shapes of names that no catalogue holds.
UNKNOWN = (r"(?<![\w-])[A-Z]{2,8}(?:-[A-Z0-9]{1,8})+(?![\w-])", r"(?<![\w-])[A-Z]{3,8}(?![\w-])", r"(?<![\w-])(?:[A-Z][A-Za-z]+\s+){1,3}[A-Z][A-Za-z]+(?![\w-])")


def aliases(entities: DataFrame, key=word_key) -> DataFrame:
    """(alias_key, n_words, entity_id, type, canonical_name): every name of every entity, once."""
    names = entities.select("entity_id", "type", "canonical_name", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return names.withColumn("alias_key", key("alias")).filter("alias_key <> ''").dropDuplicates(["entity_id", "alias_key"]).select("alias_key", F.size(F.split("alias_key", " ")).alias("n_words"), "entity_id", "type", "canonical_name")


def phrase_matches(docs: DataFrame, entities: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity_id, type, canonical_name, n_aliases): entities one of whose names stands in the text as a
    whole phrase. The text's runs of as many words as some name has join the names on equality; no text
    meets a name that it does not hold.
    """
    named = aliases(entities)
    lengths = [r["n_words"] for r in named.select("n_words").distinct().orderBy("n_words").collect()]
    tokens = docs.select(F.col(key), words(text).alias("w"))
    run = lambda n: F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, F.lit(n)), " "))
    runs = F.array_distinct(F.flatten(F.array(*[F.when(F.size("w") >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in lengths])))
    phrases = tokens.select(key, F.explode(runs).alias("alias_key"))
    return phrases.join(named, "alias_key").groupBy(key, "entity_id", "type", "canonical_name").agg(F.count(F.lit(1)).alias("n_aliases"))


def mentions(examples: DataFrame, key: str, text: str, labels: str = "labels") -> DataFrame:
    """(key, category, mention, start, end, n_occurrences, unique): each labelled name with its first literal
    place in the text, null where it does not occur literally. Repeated names of a category count once."""
    def tagged(kind: str) -> Column:
        names = F.coalesce(F.col(f"{labels}.{kind}"), F.array().cast("array<string>"))
        return F.transform(names, lambda v: F.struct(F.lit(kind).alias("category"), v.alias("mention")))

    tags = F.flatten(F.array(*[tagged(k) for k in CATEGORIES.values()]))
    rows = examples.select(F.col(key), F.col(text).alias("_text"), F.explode(F.array_distinct(tags)).alias("m")).select(key, "_text", "m.category", "m.mention").filter("mention <> ''")
    start = first_offset("_text", "mention")
    n = occurrences("_text", "mention")
    return rows.select(key, "category", "mention", start.alias("start"), (start + F.length("mention")).alias("end"), F.coalesce(n, F.lit(0).cast("long")).alias("n_occurrences"), F.coalesce(n == 1, F.lit(False)).alias("is_unique"))


def alias_targets(names: DataFrame, entities: DataFrame, surface: str) -> DataFrame:
    """(surface, n_targets, entity_id): the entity that a name stands for, null if there is none or several."""
    targets = aliases(entities).groupBy("alias_key").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("only"))
    wanted = names.select(F.col(surface).alias("surface")).distinct().withColumn("alias_key", word_key("surface"))
    return wanted.join(targets, "alias_key", "left").select("surface", F.coalesce("n", F.lit(0)).alias("n_targets"), F.when(F.col("n") == 1, F.col("only")).alias("entity_id"))


def letter_runs(c: str | Column) -> Column:
    """The different runs of three characters of a name's words, a blank before and after it."""
    cut = lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 2, F.lit(1))), lambda i: F.substring(p, i, F.lit(3))))
    return let(F.concat(F.lit(" "), col(c), F.lit(" ")), cut)


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters. Python is needed for the longest blocks."""
    return pd.Series([round(SequenceMatcher(None, x, y, autojunk=False).ratio(), 5) for x, y in zip(a, b)], dtype="float64")


def lexical_candidates(names: DataFrame, entities: DataFrame, surface: str, k: int = 10) -> DataFrame:
    """(surface, entity_id, ratio, rank): the k catalogue names most like each distinct surface.

    The ratio is that of matching blocks over word keys, the best of an entity's names. Only names that share
    a run of three characters with the surface are compared; they meet on equality of the run.
    """
    wanted = names.select(F.col(surface).alias("surface")).distinct().withColumn("name_key", word_key("surface")).filter("name_key <> ''")
    left = wanted.select("name_key").distinct().withColumn("run", F.explode(letter_runs("name_key")))
    right = aliases(entities).select("alias_key").distinct().withColumn("run", F.explode(letter_runs("alias_key")))
    pairs = left.join(right, "run").select("name_key", "alias_key").distinct().withColumn("ratio", block_ratio("name_key", "alias_key"))
    scored = pairs.join(aliases(entities).select("entity_id", "alias_key"), "alias_key").groupBy("name_key", "entity_id").agg(F.max("ratio").alias("ratio"))
    return wanted.join(best(scored, ["name_key"], [F.desc("ratio"), F.asc("entity_id")], k), "name_key").select("surface", "entity_id", "ratio", "rank")


def weighted_mode(rows: DataFrame, by: str, value: str, weight: Column) -> DataFrame:
    """(by, value, weight, n): the value of most weight; ties go to the smallest value."""
    sums = rows.groupBy(by, value).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("c"))
    return sums.groupBy(by).agg(F.min_by(value, F.struct(-F.col("w"), value)).alias(value), F.max("w").alias("weight"), F.sum("c").alias("n"))


def unknown_names(docs: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name_key, value): names by their shape that do not overlap a known name of the text.

    known: (key, alias_key). A later shape's spelling replaces an earlier one's. A name overlaps if it holds a
    known name as a phrase or is held by one.
    """
    def shaped(number: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(number).alias("shape"), F.trim(v).alias("value")))

    found = F.flatten(F.array(*[shaped(i, p) for i, p in enumerate(UNKNOWN)]))
    rows = docs.select(F.col(key), F.posexplode(found).alias("pos", "c")).select(key, "pos", "c.value").withColumn("name_key", word_key("value")).filter(F.length("name_key") >= 3)
    names = rows.groupBy(key, "name_key").agg(F.max_by("value", "pos").alias("value"))
    held = F.concat(F.lit(" "), "name_key", F.lit(" "))
    also = F.concat(F.lit(" "), "alias_key", F.lit(" "))
    overlapping = names.join(known, key).filter(F.contains(held, also) | F.contains(also, held)).select(key, "name_key").distinct()
    return names.join(overlapping, [key, "name_key"], "left_anti")


def threshold_sweep(scored: DataFrame, score: str, correct: str, least: int = 10, precision: float = 0.9) -> DataFrame:
    """(threshold, accepted, correct, precision, chosen) at 100 points from 0.5 to 0.995.

    Rows are counted by the highest point they pass, then summed from above: no row meets a hundred points.
    The chosen point is the lowest with enough accepted rows at enough precision.
    """
    step = F.least(F.lit(99), F.floor((F.col(score) - 0.5) / 0.005 + 1e-9)).cast("int")
    counts = scored.filter(F.col(score) >= 0.5).groupBy(step.alias("i")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("int")).alias("c"))
    points = scored.sparkSession.range(100).select(F.col("id").cast("int").alias("i"))
    above = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    swept = points.join(counts, "i", "left").select("i", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("accepted"), F.coalesce(F.sum("c").over(above), F.lit(0)).alias("correct"))
    good = (F.col("accepted") >= least) & (F.col("correct") >= precision * F.col("accepted"))
    first = F.min(F.when(good, F.col("i"))).over(Window.partitionBy(F.lit(1)))
    return swept.select(F.round(0.5 + F.col("i") * 0.005, 3).alias("threshold"), "accepted", "correct", F.when(F.col("accepted") > 0, F.round(F.col("correct") / F.col("accepted"), 6)).alias("precision"), F.coalesce(F.col("i") == first, F.lit(False)).alias("chosen"))


def trained_catalogue(links: DataFrame, order: str, most: int = 3000) -> DataFrame:
    """Entities as their links in training show them: entity_id, name, alias_keys, context, n_links.

    links: entity_id, surface, language, context and an order. The name is the surface of most weight, an
    English use counting three times, the one seen first at ties; the context is the last English one, else
    the first seen. The entities of most links are kept, smaller ids at ties.
    """
    english = F.col("language") == "en"
    names = links.groupBy("entity_id", "surface").agg(F.sum(F.when(english, 3).otherwise(1)).alias("w"), F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    named = names.groupBy("entity_id").agg(F.min_by("surface", F.struct(-F.col("w"), "seen")).alias("name"), F.array_sort(F.collect_set(word_key("surface"))).alias("alias_keys"), F.sum("n").alias("n_links"))
    contexts = links.groupBy("entity_id").agg(F.coalesce(F.max_by(F.when(english, F.col("context")), F.when(english, F.col(order))), F.min_by("context", order)).alias("context"))
    top = named.withColumn("_all", F.lit(0))
    return best(top, ["_all"], [F.desc("n_links"), F.asc("entity_id")], most).drop("_all", "rank").join(contexts, "entity_id")


def commonest(links: DataFrame, surface: str, entity: str, order: str) -> DataFrame:
    """(surface, entity, n): the entity that a surface most often stands for, the one seen first at ties."""
    counts = links.groupBy(surface, entity).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(surface).agg(F.min_by(entity, F.struct(-F.col("n"), "seen", entity)).alias(entity), F.max("n").alias("n"))


def split_aliases(c: str | Column, canonical: str | Column, sep: str = "|||") -> Column:
    """The names of a separated list, trimmed, each once, without the canonical one and blanks."""
    parts = F.transform(F.split(col(c), "\\Q" + sep + "\\E"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & ~x.eqNullSafe(F.trim(col(canonical)))))


def word_vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, feature, weight): texts as vectors of length one over their different words of two letters or more."""
    found = rows.select(key, F.array_distinct(words(text, 2)).alias("_w")).filter(F.size("_w") > 0)
    return found.select(key, F.explode("_w").alias("feature"), (1 / F.sqrt(F.size("_w"))).alias("weight"))


def link_features(mentions: DataFrame, catalogue: DataFrame, k: int = 10) -> DataFrame:
    """The k entities nearest to each mention: mention_id, entity_id, mention_score, context_score, lexical,
    product, place.

    mentions: mention_id, surface, context; catalogue: entity_id, name, alias_keys, context. Surfaces and names
    meet on equal runs of three characters, which give the mention score; contexts are compared by their words,
    for those pairs only. lexical is 1 where the surface is one of the aliases, else the share of runs in
    common. Order is by the sum of the first three, then by entity.
    """
    keyed = mentions.withColumn("name_key", word_key("surface")).filter("name_key <> ''")
    names = catalogue.withColumn("cat_key", word_key("name"))
    runs = lambda df, c: df.select(F.col(c)).distinct().withColumn("_r", letter_runs(c)).select(c, F.size("_r").alias(f"_n_{c}"), F.explode("_r").alias("run"))
    shared = runs(keyed, "name_key").join(runs(names, "cat_key"), "run").groupBy("name_key", "cat_key", "_n_name_key", "_n_cat_key").agg(F.count(F.lit(1)).alias("_s"))
    alike = shared.select("name_key", "cat_key", F.round(F.col("_s") / F.sqrt(F.col("_n_name_key") * F.col("_n_cat_key")), 5).alias("mention_score"), F.round(F.col("_s") / (F.col("_n_name_key") + F.col("_n_cat_key") - F.col("_s")), 5).alias("_common"))
    pairs = keyed.select("mention_id", "name_key").join(alike, "name_key").join(names.select("cat_key", "entity_id", "alias_keys"), "cat_key")
    said = word_vectors(mentions, "mention_id", "context").withColumnRenamed("weight", "_wm")
    told = word_vectors(catalogue, "entity_id", "context").withColumnRenamed("weight", "_we")
    near = pairs.select("mention_id", "entity_id").join(said, "mention_id").join(told, ["entity_id", "feature"]).groupBy("mention_id", "entity_id").agg(F.round(F.sum(F.col("_wm") * F.col("_we")), 5).alias("context_score"))
    both = pairs.join(near, ["mention_id", "entity_id"], "left").withColumns({"context_score": F.coalesce("context_score", F.lit(0.0)), "lexical": F.when(F.array_contains("alias_keys", F.col("name_key")), 1.0).otherwise(F.col("_common"))})
    total = F.round(F.col("mention_score") + F.col("context_score") + F.col("lexical"), 5)
    ranked = best(both.withColumn("_t", total), ["mention_id"], [F.desc("_t"), F.asc("entity_id")], k)
    return ranked.select("mention_id", "entity_id", "mention_score", "context_score", "lexical", F.round(F.col("mention_score") * F.col("context_score"), 5).alias("product"), F.col("rank").alias("place"))


def link_score(features: list[str], mean: list[float], scale: list[float], coef: list[float], intercept: float) -> Column:
    """The logistic of standardised features under given coefficients, its argument kept within 50."""
    z = sum(((F.col(f) - m) / s * c for f, m, s, c in zip(features, mean, scale, coef)), F.lit(float(intercept)))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))


def linked(scored: DataFrame, score: str, threshold: float, shown: int = 3) -> DataFrame:
    """(mention_id, entity_id, score, status, candidates): the best candidate of each mention, accepted from the
    threshold on; candidates are kept either way, best first, smaller entities at ties."""
    if not 1 <= shown <= 10:
        raise ValueError("from 1 to 10 candidates are shown")
    lists = scored.groupBy("mention_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "entity_id"))), 1, shown).alias("c"))
    first = -F.col("c")[0]["s"]
    return lists.select("mention_id", F.when(first >= threshold, F.col("c")[0]["entity_id"]).alias("entity_id"), first.alias("score"), F.when(first >= threshold, "linked").otherwise("unresolved").alias("status"), F.transform("c", lambda x: x["entity_id"]).alias("candidates"))
