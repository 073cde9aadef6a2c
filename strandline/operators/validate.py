"""Checks that give each record a list of errors and never change it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.tables import latest


def errors(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that do not hold; a check that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def filled(c: str) -> Column:
    return F.length(F.trim(c)) > 0


def http_url(c: str) -> Column:
    """Whether a text is an http or https address with a host."""
    return F.col(c).rlike(r"^https?://[^/\s:?#]+")


# A day with or without a time and its zone; the states of a review.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
STATES = ("approved", "pending", "rejected")


def document_errors(df: DataFrame) -> Column:
    """Empty texts, addresses without host, times that are none, states of no known name, and null flags of a
    corpus document."""
    names = ("document_id", "source_id", "source_url", "published_at", "language", "title", "text", "review_status")
    checks = [(f"{c} is empty", filled(c)) for c in names]
    checks.append(("source_url is no address", http_url("source_url")))
    checks.append(("published_at is no ISO time", F.col("published_at").rlike(ISO_TIME) & F.try_to_date(F.substring("published_at", 1, 10), "yyyy-MM-dd").isNotNull()))
    checks.append(("review_status is of no known name", F.col("review_status").isin(*STATES)))
    checks.append(("allowed_for_training is null", F.col("allowed_for_training").isNotNull()))
    return errors(*checks)


def divided(df: DataFrame, found: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Rows without errors and rows with some."""
    return df.filter(F.size(found) == 0), df.filter(F.size(found) > 0)


def article_errors(article: str = "article") -> Column:
    """Errors of an article that is handed in: a body of 20 to 15,000 characters, a title of at most 500."""
    size = lambda c: F.length(F.trim(f"{article}.{c}"))
    return errors(("body is not of 20 to 15000 characters", size("body").between(20, 15_000)), ("title is longer than 500 characters", F.coalesce(size("title"), F.lit(0)) <= 500))


def article_key(article: str = "article") -> Column:
    """An article's id, or one that its title and body give."""
    part = lambda c: F.coalesce(F.col(f"{article}.{c}"), F.lit(""))
    own = F.substring(F.sha2(F.concat(part("title"), F.lit("\n"), part("body")), 256), 1, 20)
    return F.coalesce(F.when(filled(f"{article}.article_id"), F.col(f"{article}.article_id")), own)


# What a source manifest may state.
RIGHTS = ("approved", "unknown", "requires_authorization", "denied")


def manifest_errors(sources: DataFrame) -> DataFrame:
    """(source_id, errors) of each row of a source manifest: an id that is empty or there twice, rights of no
    known name, no address, training allowed without a licence."""
    twice = sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = sources.join(twice, sources.source_id.eqNullSafe(twice.source_id), "left").drop(twice.source_id)
    training = F.coalesce(F.array_contains("allowed_uses", "model_training"), F.lit(False)) & (F.col("rights_status") == "approved")
    checks = errors(("source_id is empty", filled("source_id")), ("source_id is there twice", F.col("_n") == 1), ("rights are of no known name", F.col("rights_status").isin(*RIGHTS)), ("homepage is no address", http_url("homepage")), ("training without a licence", ~F.coalesce(training, F.lit(False)) | F.coalesce(filled("license_id"), F.lit(False))))
    return rows.select("source_id", checks.alias("errors"))


# The keys of an extraction by the version of its schema.
SCHEMAS = {2: ("companies", "countries", "organizations", "profiles", "systems", "topics", "relationships"), 3: ("companies", "countries", "locations", "organizations", "profiles", "systems", "topics", "relationships")}


def response_errors(response: str | Column, version: int) -> Column:
    """Errors of an extraction as JSON text: not just the version's keys, a category that is no list of
    non-blank strings, a relationship that has not just a non-blank subject, relation and object. One error,
    "no object", for null and for what is no JSON object."""
    text = F.col(response) if isinstance(response, str) else response
    keys = SCHEMAS[version]
    part = lambda k: F.get_json_object(text, f"$.{k}")
    strings = lambda k: F.from_json(part(k), "array<string>")
    # from_json reads numbers as strings: each item must be written with a quote
    listed = lambda k: F.coalesce(part(k).rlike(r'(?s)^\s*\[\s*("(?:[^"\\]|\\.)*"\s*(,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$') & F.forall(strings(k), lambda v: F.coalesce(F.trim(v) != "", F.lit(False))), F.lit(False))
    roles = ("subject", "relation", "object")
    each = F.from_json(part("relationships"), "array<map<string,string>>")
    related = F.forall(each, lambda r: (F.array_sort(F.map_keys(r)) == F.array(*[F.lit(x) for x in sorted(roles)])) & F.forall(F.map_values(r), lambda v: F.coalesce(F.trim(v) != "", F.lit(False))))
    checks = errors(("keys are not those of the schema", F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in sorted(keys)])), *[(f"{k} is no list of names", listed(k)) for k in keys[:-1]], ("relationships are malformed", F.coalesce(related, F.lit(False))))
    return F.when(F.json_object_keys(text).isNull(), F.array(F.lit("no object"))).otherwise(checks)


def ungrounded(text: str | Column, values: Column) -> Column:
    """The values that do not stand in the text as they are; all of them where the text is null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: ~F.coalesce(F.contains(t, v), F.lit(False)))


def filter_errors(filters: str, categories: tuple[str, ...]) -> Column:
    """Errors of a map of category to names: categories of no known name, lists that are null or hold blanks.
    No error for null."""
    known = F.array(*[F.lit(c) for c in categories])
    entries = F.coalesce(F.map_entries(filters), F.array().cast("array<struct<key:string,value:array<string>>>"))
    return errors(("unknown category", F.forall(entries, lambda e: F.array_contains(known, e["key"]))), ("names are missing or blank", F.forall(entries, lambda e: F.coalesce(F.forall(e["value"], lambda v: F.coalesce(F.trim(v) != "", F.lit(False))), F.lit(False)))))


def disagreeing(df: DataFrame, stored: str, recomputed: Column) -> DataFrame:
    """The rows whose stored value is not what it is when it is worked out again, with that as "recomputed"."""
    return df.withColumn("recomputed", recomputed).filter(~F.col(stored).eqNullSafe(F.col("recomputed")))


def quarantined(rows: DataFrame, attempts: DataFrame, key: str, order: Column, found: str = "errors") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid rows, the last invalid row of each key, the attempts with those of invalid rows rejected).

    An accepted attempt whose key has an invalid row and no valid one becomes rejected and keeps what it was as
    original_outcome; others have null there.
    """
    good, bad = divided(rows, found)
    last = latest(bad, [key], order)
    wrong = last.select(key).join(good.select(key).distinct(), key, "left_anti").withColumn("_bad", F.lit(True))
    marked = attempts.join(wrong, key, "left").withColumn("_hit", F.coalesce(F.col("_bad"), F.lit(False)) & (F.col("outcome") == "accepted"))
    return good, last, marked.withColumns({"original_outcome": F.when(F.col("_hit"), F.col("outcome")), "outcome": F.when(F.col("_hit"), "rejected").otherwise(F.col("outcome"))}).drop("_bad", "_hit")
