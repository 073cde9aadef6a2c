"""Deterministic orders and samples; ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.staging import staged


def group_ranks(df: DataFrame, by: str, order: list[Column], name: str = "rank") -> DataFrame:
    """The rows with their rank inside their group, from 1, for groups too large for one task.

    Rows are sorted over all tasks by group and order; each task counts its rows of each group, and the ranks
    of a task start after the counts of those before it. A null group is a group.
    """
    kept = _sorted_parts(df, by, order)
    counts = kept.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = kept.join(starts, kept[by].eqNullSafe(starts["_by"]) & (kept["_part"] == starts["_p"]))
    return joined.withColumn(name, F.col("_start") + F.col("_row") - F.col("_first") + 1).drop("_by", "_p", "_start", "_first", "_part", "_row")


def _sorted_parts(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The rows sorted over all tasks, kept with the number of their task and their place in it."""
    tie = [F.col(by), *order]
    return staged(df.repartitionByRange(*tie).sortWithinPartitions(*tie).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))


def round_robin(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The rows with their turn: all groups' first rows, then all second rows, until the longest ends."""
    return group_ranks(df, by, order, "turn")


def hash_sample(df: DataFrame, by: str, key: str, n: int, salt: str = "") -> DataFrame:
    """n rows of each group by the SHA-256 of salt and key, with their rank; groups are cut before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def pooled(ranked: DataFrame, by: str, key: str, position: str, method: str, depth: int = 10) -> DataFrame:
    """The first different records of several rankings, rank by rank, methods in their order."""
    first = ranked.groupBy(by, key).agg(F.min(F.struct(position, method)).alias("_f"))
    w = Window.partitionBy(by).orderBy("_f", key)
    return first.withColumn("pool_rank", F.row_number().over(w)).filter(F.col("pool_rank") <= depth).select(by, key, "pool_rank", F.col(f"_f.{method}").alias("from_method"))


def running_total(df: DataFrame, by: str, order: list[Column], amount: str, limit: float) -> DataFrame:
    """The rows of each group, in order, as long as the sum of amounts (to 6 places) stays within a limit.

    Sums run inside the parts of a sort over all tasks, on top of the sums of the parts before: a group may be
    larger than one task. A null amount adds nothing.
    """
    kept = _sorted_parts(df, by, order)
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = kept.groupBy(by, "_part").agg(F.sum(amount).alias("_s"))
    starts = sums.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_start"))
    inside = F.sum(amount).over(Window.partitionBy(by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    joined = kept.withColumn("_in", inside).join(starts, kept[by].eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("running", F.round(F.col("_start") + F.coalesce("_in", F.lit(0.0)), 6)).filter(F.col("running") <= limit).drop("_by", "_p", "_start", "_in", "_part", "_row")


def evaluation_roles(df: DataFrame, by: str, key: str, first: int = 5) -> DataFrame:
    """The rows with role: validation for the first of each group by a hash of the key, test for the rest."""
    hashed = df.withColumn("_h", F.sha2(F.col(key).cast("string"), 256))
    return group_ranks(hashed, by, [F.asc("_h"), F.asc(key)], "_r").withColumn("role", F.when(F.col("_r") <= first, "validation").otherwise("test")).drop("_h", "_r")


def capped(df: DataFrame, owner: str, position: str, by: str, key: Column, each: int, most: int) -> DataFrame:
    """The first rows of each owner by position, and of these so many of each group by a hash of the key."""
    few = df.withColumn("_r", F.row_number().over(Window.partitionBy(owner).orderBy(position))).filter(F.col("_r") <= each).drop("_r")
    return group_ranks(few.withColumn("_h", F.sha2(key, 256)), by, [F.asc("_h")], "place").filter(F.col("place") <= most).drop("_h")


def epoch_order(df: DataFrame, key: str, epochs: int, seed: str) -> DataFrame:
    """(epoch, key, place): another order of all rows for each epoch, a function of seed, epoch and key alone."""
    each = df.select(F.col(key), F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    return group_ranks(each.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), "epoch", F.col(key).cast("string")), 256)), "epoch", [F.asc("_h"), F.asc(key)], "place").select("epoch", key, "place")


def remaining(df: DataFrame, done: DataFrame, by: str, key: str, order: list[Column]) -> DataFrame:
    """(by, key, place, in_order): rows that are not done; in_order says whether what is done of their group is
    just its beginning, so that work can go on after it."""
    placed = group_ranks(df, by, order, "place").join(done.select(key).distinct().withColumn("_d", F.lit(True)), key, "left")
    spans = placed.groupBy(by).agg(F.count("_d").alias("_n"), F.coalesce(F.max(F.when(F.col("_d"), F.col("place"))), F.lit(0)).alias("_last")).select(F.col(by).alias("_by"), (F.col("_n") == F.col("_last")).alias("in_order"))
    return placed.filter("_d is null").join(spans, placed[by].eqNullSafe(F.col("_by"))).select(by, key, "place", "in_order")


def order_changes(ranked: DataFrame, by: str, method: str, key: str, position: str, one: str, other: str, k: int = 5) -> DataFrame:
    """(by, before, after, changed) of the first k different records by two methods; groups with fewer than k
    by either have null for changed."""
    firsts = ranked.filter(F.col(method).isin(one, other)).groupBy(by, method, key).agg(F.min(position).alias("_p"))
    top = firsts.withColumn("_r", F.row_number().over(Window.partitionBy(by, method).orderBy("_p", key))).filter(F.col("_r") <= k)
    listed = lambda m: F.transform(F.array_sort(F.collect_list(F.when(F.col(method) == m, F.struct("_r", key)))), lambda x: x[key])
    both = top.groupBy(by).agg(listed(one).alias("before"), listed(other).alias("after"))
    return both.select(by, "before", "after", F.when((F.size("before") == k) & (F.size("after") == k), F.col("before") != F.col("after")).alias("changed"))


def session_runs(df: DataFrame, by: str, time: str, gap_seconds: int) -> DataFrame:
    """(by, first, last, n): runs of a group's rows with shorter pauses than the gap, for groups of any size.

    Rows are sorted over all tasks; each part's first row looks back at the last row of the parts before it, and
    runs are numbered by sums over parts. Rows of a null time are left out; works on tables (streams have windows).
    """
    kept = _sorted_parts(df.select(by, time).filter(F.col(time).isNotNull()), by, [F.asc(time)])
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = kept.groupBy(by, "_part").agg(F.max(time).alias("_end"))
    before = ends.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.max("_end").over(earlier).alias("_before"))
    joined = kept.join(before, kept[by].eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p"))).drop("_by", "_p")
    last = F.coalesce(F.lag(time).over(Window.partitionBy(by, "_part").orderBy("_row")), F.col("_before"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    starts = joined.withColumn("_starts", F.coalesce(micros(F.col(time)) - micros(last) >= gap_seconds * 1_000_000, F.lit(True)).cast("long"))
    marked = staged(starts.select(by, time, "_part", "_row", "_starts"))
    counts = marked.groupBy(by, "_part").agg(F.sum("_starts").alias("_c"))
    offsets = counts.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.sum("_starts").over(Window.partitionBy(by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.withColumn("_in", inside).join(offsets, marked[by].eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return numbered.groupBy(by, (F.col("_offset") + F.col("_in")).alias("_run")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")
