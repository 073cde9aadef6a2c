"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.plans.staging import dropped, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The component of each node that has an edge: (node, component), a component's name being its least node.

    Alternates two steps until no edge changes: each node links its larger neighbours to the least node it
    sees, then each node links its smaller neighbours to that least node. The number of rounds grows with the
    logarithm of the longest path. Each round is a grouping and a join on the node, so a hub's edges are
    combined before the shuffle and its join partition can be split. Edges with a null end are left out,
    loops give a component of one node, repeated edges count once.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = ends.select("u").union(ends.select("v")).distinct()
    now = staged(ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(small_least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(down.union(small_least.select("u", F.col("m").alias("v"))).distinct())
        dropped(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
