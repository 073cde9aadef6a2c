"""Problem 1: splits that keep related records together."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import language_name, source_name, split_name
from strandline.operators.graph import connected_components
from strandline.plans.staging import staged

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Components of one part of a bundle, in which they are ranked.
RANKED = 200_000
#: Cost of a row above one quota and, with it, below another, where a row outside its preferred split costs 1.
DEVIATION = 4.0


def groups(rows: DataFrame, key: str = "record_id", source: str = "source_id", document: str = "document_id") -> DataFrame:
    """The rows with group_id: rows that share a source or a document, directly or through others, have one.

    Documents are reduced to their least source before any graph is built, so the graph's nodes are sources,
    and each of its edges is one pair of sources, however many documents join them. A row without source and
    document is a group of its own; so is a document none of whose rows has a source. Blank ids are null.
    """
    doc = F.when(F.trim(document) != "", F.col(document))
    named = rows.withColumns({"_s": source_name(source), "_d": doc})
    least = named.filter("_d is not null and _s is not null").groupBy("_d").agg(F.min("_s").alias("_m"))
    both = named.join(least, "_d", "left")
    links = both.filter("_s is not null and _m is not null and _s <> _m").select(F.col("_s").alias("a"), F.col("_m").alias("b")).distinct()
    parts = connected_components(links)
    root = F.coalesce("_m", "_s")
    found = both.withColumn("_root", root).join(parts.select(F.col("node").alias("_root"), "component"), "_root", "left")
    name = F.when(F.col("_root").isNotNull(), F.concat(F.lit("s:"), F.coalesce("component", "_root"))).when(F.col("_d").isNotNull(), F.concat(F.lit("d:"), "_d")).otherwise(F.concat(F.lit("r:"), F.col(key).cast("string")))
    return found.withColumn("group_id", name).drop("_s", "_d", "_m", "_root", "component")


def allocate(bundles: list[tuple[int, int, str | None]], shares: dict[str, float], deviation: float = DEVIATION) -> list[dict[str, int]]:
    """For each bundle of (size, components, preferred split): how many of its components go to each split.

    A min-cost flow from bundles through splits to quotas: a row outside its preferred split costs one, a row
    beyond a quota costs the deviation. All rows begin in their preferred split (in all, by quota, if they have
    none); then rows are moved along the cheapest path from a split that has too many to one that has too
    few, as long as a path costs less than the deviation that it saves. Each arc between two splits keeps a
    heap of the bundles that can take it, so that a move costs the logarithm of their number; each move
    empties a bundle's share of a split or meets a quota. Whole components are then rounded down, and the
    rest go, largest first, where most is lacking.
    """
    names = list(shares)
    total = sum(s * n for s, n, _ in bundles)
    quota = [shares[j] / sum(shares.values()) * total for j in names]
    likes = [names.index(k) if k in shares else None for _, _, k in bundles]
    splits = range(len(names))
    flow = [[float(s * n) * (k == j if k is not None else quota[j] / max(total, 1)) for j in splits] for (s, n, _), k in zip(bundles, likes)]
    held = [sum(f[j] for f in flow) for j in splits]
    price = lambda i, a, b: 0 if likes[i] is None else (likes[i] == a) - (likes[i] == b)
    # of equal costs the smallest components move: they can be rounded best
    arcs = {(a, b): [(price(i, a, b), bundles[i][0], i) for i in range(len(bundles)) if flow[i][a] > 0] for a in splits for b in splits if a != b}
    for heap in arcs.values():
        heapify(heap)
    while True:
        over = [j for j in splits if held[j] - quota[j] > 0.5]
        for (a, _), heap in arcs.items():
            while heap and flow[heap[0][2]][a] <= 1e-9:
                heappop(heap)
        dist = {j: (0, None) for j in over}
        for _ in splits:
            for (a, b), heap in arcs.items():
                if heap and a in dist and (b not in dist or dist[a][0] + heap[0][0] < dist[b][0]):
                    dist[b] = (dist[a][0] + heap[0][0], a)
        short = [j for j in splits if quota[j] - held[j] > 1e-9 and j in dist and j not in over]
        end = min(short, key=lambda j: dist[j][0], default=None)
        if end is None or dist[end][0] >= deviation:
            break
        path = [end]
        while dist[path[-1]][1] is not None and len(path) <= len(names):
            path.append(dist[path[-1]][1])
        path.reverse()
        steps = [(a, b, arcs[a, b][0][2]) for a, b in zip(path, path[1:])]
        amount = min([held[path[0]] - quota[path[0]], quota[end] - held[end], *(flow[i][a] for a, _, i in steps)])
        for a, b, i in steps:
            fresh = flow[i][b] <= 1e-9
            flow[i][a] -= amount
            flow[i][b] += amount
            if fresh:
                for c in splits:
                    if c != b:
                        heappush(arcs[b, c], (price(i, b, c), bundles[i][0], i))
        held[path[0]] -= amount
        held[end] += amount
    out = [{j: int(f[k] / s + 1e-6) if s else 0 for k, j in enumerate(names)} for f, (s, _, _) in zip(flow, bundles)]
    left = {j: quota[k] - sum(o[j] * s for o, (s, _, _) in zip(out, bundles)) for k, j in enumerate(names)}
    for i in sorted(range(len(bundles)), key=lambda i: -bundles[i][0]):
        size, n, liked = bundles[i]
        for _ in range(n - sum(out[i].values())):
            j = max(names, key=lambda j: (left[j], j == liked))
            out[i][j] += 1
            left[j] -= size
    return out


def assign(rows: DataFrame, key: str = "record_id", source: str = "source_id", document: str = "document_id", split: str = "split", language: str = "language", shares: dict[str, float] | None = None, deviation: float = DEVIATION) -> DataFrame:
    """One row for each row: key, group_id, stored split, the split of most rows of its group, the assigned
    split, and torn: the stored split is known and is not that of most rows of the group.

    Components of one size, one most frequent stored split and one most frequent language form a bundle.
    Bundles, not components, go to the driver: their number is at most the root of twice the number of rows,
    times splits and languages. Ties between splits go to train, then validation, then test. Null splits
    count for no split; a group without any has none and no torn row. An empty table gives no rows.
    """
    shares = shares or SHARES
    order = F.create_map(*[F.lit(x) for j, k in zip(shares, range(len(shares))) for x in (j, k)])
    slim = rows.select(key, source, document, split_name(split).alias("stored"), language_name(language).alias("lang"))
    placed = staged(groups(slim, key, source, document).select(key, "group_id", "stored", "lang"))
    votes = placed.groupBy("group_id", "stored").agg(F.count(F.lit(1)).alias("n"))
    most = votes.groupBy("group_id").agg(
        F.sum("n").alias("size"),
        F.max_by("stored", F.when(F.col("stored").isNotNull(), F.struct("n", -F.coalesce(order[F.col("stored")], F.lit(99)), "stored"))).alias("group_split"),
    )
    tongues = placed.groupBy("group_id", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("group_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("group_lang"))
    components = staged(most.join(tongues, "group_id"))
    profile = ["size", "group_split", "group_lang"]
    counted = components.groupBy(*profile).agg(F.count(F.lit(1)).alias("n")).orderBy(*profile).collect()
    cuts = []
    for b, share in zip(counted, allocate([(r["size"], r["n"], r["group_split"]) for r in counted], shares, deviation)):
        start = 0
        for j, n in share.items():
            if n:
                cuts.append((b["size"], b["group_split"], b["group_lang"], j, start, start + n))
                start += n
    spark = rows.sparkSession
    ranges = spark.createDataFrame(cuts, "size long, group_split string, group_lang string, assigned string, lo long, hi long")
    # members of a bundle in the order of a hash: ranked inside parts, after the parts before them
    bits = max(4, (sum(r["n"] for r in counted) // RANKED).bit_length())
    hashed = components.withColumn("h", F.xxhash64("group_id", F.lit(11))).withColumn("part", F.shiftrightunsigned("h", 64 - bits))
    sizes = hashed.groupBy(*profile, "part").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.withColumn("before", F.sum("m").over(Window.partitionBy(*profile).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("m")
    same = lambda a, b, cs: [a[c].eqNullSafe(b[c]) for c in cs]
    ranked = hashed.join(before, same(hashed, before, [*profile, "part"])).select(
        hashed.group_id, *[hashed[c] for c in profile],
        (F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy(*[hashed[c] for c in profile], hashed.part).orderBy("h", hashed.group_id)) - 1).alias("place"),
    )
    fate = ranked.join(ranges, [*same(ranked, ranges, profile), ranked.place >= ranges.lo, ranked.place < ranges.hi]).select("group_id", ranked.group_split, "assigned")
    torn = F.coalesce(F.col("stored").isNotNull() & (F.col("stored") != F.col("group_split")), F.lit(False))
    return placed.join(fate, "group_id").select(key, "group_id", F.col("stored").alias("stored_split"), "group_split", F.col("assigned").alias("assigned_split"), torn.alias("torn"))
