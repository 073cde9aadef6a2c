"""Measures of rankings and of extracted label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, query: str, position: str, grade: str, k: int = 5) -> DataFrame:
    """(query, ndcg, recall, n_judged): nDCG with gains 2^g - 1 against all judged grades, and the share of
    records of a grade above 0 among the first k. 0 where there is nothing to gain. Grades are whole numbers."""
    gain = lambda g, at: (F.pow(F.lit(2.0), g) - 1) / F.log2(at + 1.0)
    # counts of each grade, combined before the shuffle, hold all that the ideal order needs
    by_grade = ranked.groupBy(query, grade).agg(
        F.sum(F.when(F.col(position) <= k, gain(F.col(grade), F.col(position))).otherwise(0.0)).alias("dcg"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(position) <= k).alias("first"),
    )
    sums = by_grade.groupBy(query).agg(
        F.sum("dcg").alias("dcg"), F.sum("n").alias("n_judged"), F.sum(F.when(F.col(grade) > 0, F.col("n")).otherwise(0)).alias("relevant"),
        F.sum(F.when(F.col(grade) > 0, F.col("first")).otherwise(0)).alias("found"), F.reverse(F.array_sort(F.collect_list(F.struct(F.col(grade).alias("g"), "n")))).alias("grades"),
    )
    ideal = F.slice(F.flatten(F.transform("grades", lambda x: F.array_repeat(x["g"], F.least(x["n"], F.lit(k)).cast("int")))), 1, k)
    best = F.aggregate(F.transform(ideal, lambda g, i: gain(g, i + 1)), F.lit(0.0), lambda s, x: s + x)
    sums = sums.withColumn("best", best)
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return sums.select(query, share("dcg", "best").alias("ndcg"), share("found", "relevant").alias("recall"), "n_judged")


def label_confusion(predicted: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """Rows of on with tp, fp and fn: one of them is 1. Both sides count each row once."""
    a = predicted.select(*on).distinct().withColumn("p", F.lit(1))
    b = gold.select(*on).distinct().withColumn("g", F.lit(1))
    both = a.join(b, on, "full")
    return both.select(*on, F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0).alias("tp"), F.when(F.col("g").isNull(), 1).otherwise(0).alias("fp"), F.when(F.col("p").isNull(), 1).otherwise(0).alias("fn"))


def micro_scores(confusion: DataFrame, by: list[str]) -> DataFrame:
    """Micro precision, recall and F1 by each column of by and over all ("all"), from one grouping."""
    sums = confusion.rollup(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    over = lambda b: F.col("tp") / F.greatest(F.lit(1), b)
    p, r, f = over(F.col("tp") + F.col("fp")), over(F.col("tp") + F.col("fn")), 2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return sums.select(*[F.coalesce(c, F.lit("all")).alias(c) for c in by], "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def set_diagnostics(confusion: DataFrame, key: str, value: str) -> DataFrame:
    """For each key the sorted values that both sides have, that only gold has and that only the prediction has."""
    pick = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) == 1, F.col(value))))
    return confusion.groupBy(key).agg(pick("tp").alias("correct"), pick("fn").alias("missing"), pick("fp").alias("extra"))


def extraction_scores(outputs: DataFrame, gold: DataFrame, key: str, raw: str, errors: Column, kinds: list[str], by: list[str]) -> DataFrame:
    """Micro scores of extractions given as JSON text, by each column of by and over all.

    outputs: one row a record with its raw output and the columns of by; gold: (key, category, name), names as
    they are compared. An output that is no object, or has errors, finds nothing: all its record's gold names
    count as missed. parse_valid and schema_valid are shares of the outputs.
    """
    names = lambda k: F.transform(F.from_json(F.get_json_object(raw, f"$.{k}"), "array<string>"), lambda v: F.struct(F.lit(k).alias("category"), F.lower(F.trim(v)).alias("name")))
    judged = outputs.select(key, *by, raw, errors.alias("_e")).withColumns({"_parsed": ~F.array_contains("_e", "no object"), "_valid": F.size("_e") == 0})
    found = judged.filter("_valid").select(key, F.explode(F.flatten(F.array(*[F.coalesce(names(k), F.array().cast("array<struct<category:string,name:string>>")) for k in kinds]))).alias("n")).select(key, "n.category", "n.name").filter("name <> ''")
    wrong = label_confusion(found, gold.join(judged.select(key), key, "left_semi"), [key, "category", "name"])
    counts = wrong.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    each = judged.join(counts, key, "left").fillna(0, ["tp", "fp", "fn"])
    sums = each.rollup(*by).agg(F.count(F.lit(1)).alias("examples"), F.round(F.avg(F.col("_parsed").cast("int")), 6).alias("parse_valid"), F.round(F.avg(F.col("_valid").cast("int")), 6).alias("schema_valid"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select(*[F.coalesce(c, F.lit("all")).alias(c) for c in by], "examples", "parse_valid", "schema_valid", "tp", "fp", "fn", *micro("tp", "fp", "fn"))


def micro(tp: str, fp: str, fn: str) -> list[Column]:
    """precision, recall and f1 of counts; 0 where there is nothing to divide by."""
    over = lambda a, b: F.round(a / F.greatest(F.lit(1), b), 6)
    t = F.col(tp)
    return [over(t, t + F.col(fp)).alias("precision"), over(t, t + F.col(fn)).alias("recall"), over(2 * t, 2 * t + F.col(fp) + F.col(fn)).alias("f1")]


def recall_of_lists(found: Column, wanted: Column, places: int = 3) -> Column:
    """The share of the wanted ids that a list of ids holds; 0 where none is wanted."""
    return F.when(F.size(wanted) > 0, F.round(F.size(F.array_intersect(found, wanted)) / F.size(F.array_distinct(wanted)), places)).otherwise(0.0)


def ranking_faults(ranked: DataFrame, query: str, key: str, grade: str) -> DataFrame:
    """(query, n_repeated, n_ungraded, n_odd_grades) of rankings that are no fair input for measures: a record
    twice, a record without a grade, a grade that is not 0, 1 or 2."""
    per = ranked.groupBy(query, key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(grade).isNull()).alias("u"), F.count_if(~F.col(grade).isin(0, 1, 2)).alias("o"))
    sums = per.groupBy(query).agg(F.sum(F.col("n") - 1).alias("n_repeated"), F.sum("u").alias("n_ungraded"), F.sum("o").alias("n_odd_grades"))
    return sums.filter("n_repeated + n_ungraded + n_odd_grades > 0")


def link_scores_of(rows: DataFrame, by: list[str], null_empty: bool = True) -> DataFrame:
    """Measures of links by columns and over all, from rows with gold, accepted (null: none), alias_entity (the
    one entity of that name, or null), n_aliased (entities of that name), known (gold is in the catalogue) and
    retrieved (gold is among the candidates).

    A ratio of nothing is null, or, if not null_empty, 0 (denominators of at least one).
    """
    right, none = F.col("accepted") == F.col("gold"), F.col("accepted").isNull()
    subsets = {"accepted_precision": (~none, right), "accepted_coverage": (F.lit(True), ~none), "correct_link_accuracy": (F.lit(True), right), "unique_alias_accuracy": (F.lit(True), F.col("alias_entity") == F.col("gold")), "catalogue_coverage": (F.lit(True), F.col("known")), "candidate_recall_known": (F.col("known"), F.col("retrieved")), "unknown_abstention": (~F.col("known"), none), "unseen_alias_accuracy": (F.col("known") & (F.col("n_aliased") == 0), right), "ambiguous_alias_accuracy": (F.col("known") & (F.col("n_aliased") > 1), right)}
    counts = [F.count_if(of).alias(f"_n_{k}") for k, (of, _) in subsets.items()] + [F.count_if(of & F.coalesce(hit, F.lit(False))).alias(f"_h_{k}") for k, (of, hit) in subsets.items()]
    sums = rows.rollup(*by).agg(F.count(F.lit(1)).alias("mentions"), F.count_if(~none).alias("n_accepted"), *counts)
    ratio = lambda k: F.when(F.col(f"_n_{k}") > 0, F.round(F.col(f"_h_{k}") / F.col(f"_n_{k}"), 6)).otherwise(None if null_empty else 0.0).alias(k)
    return sums.select(*[F.coalesce(c, F.lit("all")).alias(c) for c in by], "mentions", "n_accepted", *[ratio(k) for k in subsets])
