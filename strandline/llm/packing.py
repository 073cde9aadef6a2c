"""Problem 6: texts packed into containers of a fixed number of tokens."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.tokens import TOKENIZER, token_count
from strandline.plans.staging import staged

#: Texts that one task packs, and parts at most: beyond that, parts grow.
ITEMS, PARTS = 4_000, 50_000
_PLACED = "profile_id string, container_id string, position int, doc_id long, source string, piece int, token_start long, tokens int, used_tokens int, unused_tokens int"


def pack_part(sizes: np.ndarray, queue: np.ndarray, target: np.ndarray, owed: np.ndarray, capacity: int, separator: int) -> list[list[tuple[int, int, int, int]]]:
    """Containers of one part, each a list of (item, piece, start, tokens).

    queue: each item's source. Every window adds its share of the capacity to each source's deficit, then
    takes from the source that is owed most among those with an item that still fits, the largest that fits,
    and so on until nothing fits. Items above the capacity are cut into full pieces, which fill containers
    of their own, and a rest, which is packed like any item.
    """
    owed = owed.astype(np.float64).copy()
    full: list[list[tuple[int, int, int, int]]] = []
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in target]
    for i in range(len(sizes)):
        size, piece = int(sizes[i]), 0
        while size - piece * capacity > capacity:
            full.append([(i, piece, piece * capacity, capacity)])
            owed += target * capacity
            owed[queue[i]] -= capacity
            piece += 1
        rest = size - piece * capacity
        if rest:
            rows[queue[i]].append((rest, i, piece, piece * capacity))
    for r in rows:
        r.sort()
    least = np.array([r[0][0] if r else np.iinfo(np.int64).max for r in rows], np.int64)
    waiting, windows = sum(map(len, rows)), []
    while waiting:
        owed += target * capacity
        window, room = [], capacity
        while True:
            fits = least <= room
            if not fits.any():
                break
            s = int(np.argmax(np.where(fits, owed, -np.inf)))
            r = rows[s]
            tokens, i, piece, start = r.pop(bisect_right(r, (room, np.inf)) - 1)
            least[s] = r[0][0] if r else np.iinfo(np.int64).max
            window.append((i, piece, start, tokens))
            owed[s] -= tokens
            room -= tokens + separator
            waiting -= 1
            if room <= 0 or not waiting:
                break
        windows.append(window)
    return full + windows


def contents(documents: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER) -> DataFrame:
    """One row for each placed piece of a text, for each profile: container_id, position in the container, the
    text's key and source, piece number, first token, tokens, and the container's used and unused tokens.

    Separators stand between the texts of a container and count as used. Sources keep their share of all
    tokens in every window: what a part of the data holds too much or too little of a source is carried, as
    a deficit, into the parts after it. Texts of no tokens (null, empty) are placed nowhere; a null source is
    a source of its own; a key that recurs is placed as often. Profiles of no capacity are left out.
    """
    counted = documents.select(F.col(key).alias("doc_id"), F.coalesce(source, F.lit("unknown")).alias("source"), token_count(text, path).alias("tokens"))
    items = staged(counted.filter("tokens > 0"))
    # a line of settings for each profile: the table is a configuration, not data
    settings = [(r["profile_id"], r["capacity_tokens"], r["separator_tokens"] or 0) for r in profiles.filter("capacity_tokens > 0").select("profile_id", "capacity_tokens", "separator_tokens").orderBy("profile_id").collect()]
    parts = max(1, min(PARTS, -(-items.count() // ITEMS)))
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    amounts = staged(items.groupBy("source", "part").agg(F.sum("tokens").alias("tokens")))
    shares = amounts.groupBy("source").agg(F.sum("tokens").alias("of_source")).withColumn("share", F.col("of_source") / F.sum("of_source").over(Window.partitionBy(F.lit(1))))
    totals = amounts.groupBy("part").agg(F.sum("tokens").alias("of_part"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    grid = shares.select(F.col("source").alias("queue"), "share", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    carried = (
        grid.join(totals.select(F.col("part").alias("at"), "of_part"), F.col("part") == F.col("at"))
        .join(amounts.select("source", F.col("part").alias("of"), "tokens"), (F.col("queue") == F.col("source")) & (F.col("part") == F.col("of")), "left")
        .withColumn("owed", F.coalesce(F.sum(F.col("share") * F.col("of_part") - F.coalesce("tokens", F.lit(0))).over(before), F.lit(0.0)))
        .select("part", F.col("queue").alias("source"), "share", "owed")
    )

    def pack(mine: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        out = []
        carry = carry.sort_values("source")
        names = {s: i for i, s in enumerate(carry.source)}
        mine = mine.sort_values(["source", "doc_id", "tokens"]).reset_index(drop=True)
        queue = mine.source.map(names).to_numpy(np.int64) if len(mine) else np.empty(0, np.int64)
        sizes, part = mine.tokens.to_numpy(), int(carry.part.iloc[0])
        for profile, capacity, separator in settings:
            windows = pack_part(sizes, queue, carry.share.to_numpy(), carry.owed.to_numpy(), capacity, separator)
            if windows:
                held = np.array([len(w) for w in windows])
                item, piece, start, tokens = np.array([x for w in windows for x in w], np.int64).T
                begin = np.cumsum(held) - held
                used = np.add.reduceat(tokens, begin) + separator * (held - 1)
                names_of = np.array([f"{profile}-{part:06d}-{number:06d}" for number in range(len(windows))], object)
                every = lambda x: np.repeat(x, held)
                out.append(pd.DataFrame({
                    "profile_id": profile, "container_id": every(names_of), "position": np.arange(len(item)) - every(begin), "doc_id": mine.doc_id.to_numpy()[item], "source": mine.source.to_numpy()[item],
                    "piece": piece, "token_start": start, "tokens": tokens, "used_tokens": every(used), "unused_tokens": capacity - every(used),
                }))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in _PLACED.split(", ")})

    # as many tasks as parts: their bytes are few, but not the work
    spread = lambda df: df.repartition(parts, "part")
    return spread(items).groupBy("part").cogroup(spread(carried).groupBy("part")).applyInPandas(pack, _PLACED)


def fill(placed: DataFrame, profiles: DataFrame) -> DataFrame:
    """For each profile: containers, texts placed, tokens, unused tokens and the share of space left unused."""
    boxes = placed.filter("position = 0").groupBy("profile_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("unused_tokens").alias("unused"))
    held = placed.groupBy("profile_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    space = profiles.select("profile_id", "capacity_tokens")
    return space.join(boxes, "profile_id").join(held, "profile_id").select("profile_id", "containers", "pieces", "tokens", "unused", (F.col("unused") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"))
