"""Keyed tables: upserts, misses, orphans, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key: an aggregation, so that rows of a hot key are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows with one row for each key: the last by order, a new row before an old one at a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, F.struct(order, "_new")).drop("_new")


def misses(df: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not held."""
    return df.join(held.select(*keys).distinct(), keys, "left_anti")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys are in both, only left and only right, and whether the sets are equal."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right")).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def crossing(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose rows lie in more than one split: (group, n_rows, n_splits)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def table_digest(df: DataFrame, by: str) -> DataFrame:
    """(by, n_rows, digest): a digest of each group's rows that does not depend on their order.

    Sums of 32-bit pieces of each row's SHA-256 commute, so rows are combined before the shuffle.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)]), 256)
    pieces = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws("-", *[p.cast("string") for p in pieces]), 256).alias("digest"))


def first_match(df: DataFrame, held: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Each row with the first of the held rows of its key, nulls where there is none."""
    rest = [c for c in held.columns if c not in keys]
    first = held.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return df.join(first, keys, "left")


def leaks(rows: DataFrame, held: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(key, ways): rows that share a value of any of the columns with a held-out row, and which columns.

    One join for each column, on equality; null values are shared with none.
    """
    found = None
    for c in by:
        shared = rows.filter(F.col(c).isNotNull()).join(held.filter(F.col(c).isNotNull()).select(c).distinct(), c, "left_semi").select(key, F.lit(c).alias("way"))
        found = shared if found is None else found.union(shared)
    return found.groupBy(key).agg(F.array_sort(F.collect_set("way")).alias("ways"))


def gated(rows: DataFrame, key: str, content: str, order: str, eligible: Column) -> DataFrame:
    """The rows with reasons for which each is left out, none for those that are selected, in the given order.

    A key that an earlier row has is a duplicate, whether that row was selected or not; content is a duplicate
    only of an earlier selected row. What is selected is the first row of its content among those that are
    eligible and the first of their key, so that two groupings settle what reads like a loop.
    """
    marked = rows.withColumn("_ok", F.coalesce(eligible, F.lit(False)))
    firsts = marked.groupBy(key).agg(F.min(order).alias("_first"))
    known = marked.join(firsts, marked[key].eqNullSafe(firsts[key])).drop(firsts[key]).withColumn("_single", F.col(order) == F.col("_first"))
    chosen = known.filter("_ok and _single").groupBy(content).agg(F.min(order).alias("_chosen"))
    both = known.join(chosen, known[content].eqNullSafe(chosen[content]), "left").drop(chosen[content])
    reason = lambda ok, name: F.when(ok, F.lit(name))
    reasons = F.array_compact(F.array(reason(~F.col("_ok"), "not eligible"), reason(~F.col("_single"), "duplicate key"), reason(F.coalesce(F.col(order) > F.col("_chosen"), F.lit(False)), "duplicate content")))
    return both.withColumn("reasons", reasons).drop("_ok", "_first", "_single", "_chosen")


def inconsistent(rows: DataFrame, reference: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, errors) of rows whose key the reference does not hold, or whose columns differ from its row."""
    held = reference.dropDuplicates([key]).select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = rows.join(held, F.col(key) == F.col("_k"), "left")
    wrong = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]))
    return both.withColumn("errors", F.when(F.col("_k").isNull(), F.array(F.lit("unknown"))).otherwise(wrong)).filter(F.size("errors") > 0).select(*rows.columns, "errors")


def audit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(name, n_rows, n_values, n_repeated, n_missing) of each key column: rows, different values, rows beyond
    the first of their value, nulls."""
    def one(c: str) -> DataFrame:
        counts = rows.groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        known = F.col("_v").isNotNull()
        total = lambda of: F.coalesce(F.sum(F.when(of, F.col("_n"))), F.lit(0))
        return counts.agg(F.lit(c).alias("name"), total(F.lit(True)).alias("n_rows"), F.count("_v").alias("n_values"), (total(known) - F.count("_v")).alias("n_repeated"), total(~known).alias("n_missing"))

    out = one(keys[0])
    for c in keys[1:]:
        out = out.union(one(c))
    return out


def missing_values(rows: DataFrame, by: str, column: str, wanted: list[str]) -> DataFrame:
    """(by, missing): the wanted values that a group has no row of; only groups that lack some."""
    have = rows.groupBy(by).agg(F.collect_set(F.when(F.col(column).isin(*wanted), F.col(column))).alias("_h"))
    return have.select(by, F.array_sort(F.array_except(F.array(*[F.lit(w) for w in wanted]), "_h")).alias("missing")).filter(F.size("missing") > 0)


def merged_lists(rows: DataFrame, by: str, order: Column, values: str) -> DataFrame:
    """(by, values): the lists of a group's rows one after the other, each value once, where it first stands.

    A value is kept with its first place before anything is gathered, so that a group holds values, not rows.
    """
    each = rows.select(by, order.alias("_o"), F.posexplode(values).alias("_i", "_v")).filter(F.col("_v").isNotNull())
    first = each.groupBy(by, "_v").agg(F.min(F.struct("_o", "_i")).alias("_at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(values))


def with_outputs(records: DataFrame, outputs: DataFrame, key: str, order: Column, lists: list[str], approved: Column | None = None) -> DataFrame:
    """Records whose lists are joined by those of their last output, each value once and sorted; if asked for,
    of approved outputs only. Records without output keep their own."""
    last = latest((outputs if approved is None else outputs.filter(approved)).select(key, order.alias("_o"), *[F.col(c).alias(f"_{c}") for c in lists]), [key], F.col("_o")).drop("_o")
    none = F.array().cast("array<string>")
    union = lambda c: F.array_sort(F.array_union(F.coalesce(c, none), F.coalesce(f"_{c}", none)))
    return records.join(last, key, "left").withColumns({c: union(c) for c in lists}).drop(*[f"_{c}" for c in lists])


def merged_catalogue(catalogue: DataFrame, found: DataFrame, name_key: Column) -> DataFrame:
    """A catalogue (entity_id, type, canonical_name, aliases, wikidata_id) joined by found rows (type,
    canonical_name, aliases, wikidata_id).

    A found row belongs to the entity of its wikidata_id, else of its name; one whose type is another is left
    out. Others give their names as aliases, each once whatever its case. Found rows that belong to none make
    new entities, those of one id or name together, named after the smallest name; of their types the
    smallest stays. Rows without name are left out.
    """
    target = F.coalesce(F.when(F.col("wikidata_id") != "", F.concat(F.lit("q:"), "wikidata_id")), F.concat(F.lit("n:"), name_key))
    rows = found.filter(F.trim("canonical_name") != "").withColumn("_name", name_key)
    known = catalogue.withColumn("_name", name_key)
    by_id = known.filter("wikidata_id <> ''").groupBy("wikidata_id").agg(F.min("entity_id").alias("_a"))
    by_name = known.groupBy("_name").agg(F.min("entity_id").alias("_b"))
    placed = rows.join(by_id, "wikidata_id", "left").join(by_name, "_name", "left").withColumn("entity_id", F.coalesce("_a", "_b")).drop("_a", "_b")
    none = F.array().cast("array<string>")
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", none))
    fits = placed.filter("entity_id is not null").join(catalogue.select("entity_id", F.col("type").alias("_type")), "entity_id").filter(F.col("type") == F.col("_type")).select("entity_id", F.explode(names).alias("alias"))
    fresh = placed.filter("entity_id is null").withColumn("entity_id", F.concat(F.lit("new:"), F.substring(F.sha2(target, 256), 1, 12)))
    heads = fresh.groupBy("entity_id").agg(F.min("type").alias("type"), F.min("canonical_name").alias("canonical_name"), F.max("wikidata_id").alias("wikidata_id"))
    every = catalogue.select("entity_id", "type", "canonical_name", "wikidata_id").unionByName(heads)
    own = catalogue.select("entity_id", F.explode(F.coalesce("aliases", none)).alias("alias"))
    new = fresh.join(heads.select("entity_id", F.col("type").alias("_type")), "entity_id").filter(F.col("type") == F.col("_type")).select("entity_id", F.explode(names).alias("alias"))
    aliases = own.unionByName(fits).unionByName(new).filter(F.trim("alias") != "").groupBy("entity_id", F.lower("alias").alias("_l")).agg(F.min("alias").alias("alias"))
    listed = aliases.join(every.select("entity_id", F.lower("canonical_name").alias("_c")), "entity_id").filter("_l <> _c").groupBy("entity_id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return every.join(listed, "entity_id", "left").select("entity_id", "type", "canonical_name", F.coalesce("aliases", none).alias("aliases"), "wikidata_id")


def same_sets(rows: DataFrame, key: str, by: str, value: str, least: int = 3) -> DataFrame:
    """(a, b): rows of one value of by and just the same set of at least so many values, each with the first of them.

    Not all pairs: their components are the same.
    """
    sets = rows.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(key, by).agg(F.array_sort(F.collect_set(value)).alias("_s")).filter(F.size("_s") >= least)
    marked = sets.select(key, F.sha2(F.concat_ws("\x1f", F.col(by).cast("string"), F.array_join("_s", "\x1f")), 256).alias("_g"))
    several = marked.groupBy("_g").agg(F.min(key).alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return marked.join(several, "_g").filter(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))
