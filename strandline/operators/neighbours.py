"""Exact nearest neighbours of a stated set of query vectors among all vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ranking import best

#: Query vectors, and vectors, that meet in one task.
QUERIES, ROWS = 2_048, 50_000


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """(query, key, similarity, rank): for each query row its k most similar other rows by cosine.

    Up to QUERIES query vectors are sent to every task, which scans its rows in place and gives k candidates a
    query. Beyond that, blocks of queries meet blocks of rows in tasks of bounded size. Similarities are rounded
    to 5 places; ties go to the smaller key. Null vectors, vectors of no length and of another length than
    most of the table take no part.
    """
    size = rows.filter(F.size(vector) > 0).agg(F.mode(F.size(vector), True)).first()[0] or 0
    clean = lambda df: df.filter(F.size(vector) == F.lit(size)).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    held, asked = clean(rows), clean(queries)
    n = asked.count()
    if n <= QUERIES:
        sent = rows.sparkSession.sparkContext.broadcast(_units(asked.toPandas()))

        def scan(frames):
            ask, y = sent.value
            best_of = [(np.empty(0), np.empty(0, np.int64))] * len(ask)
            for pdf in frames:
                keys, x = _units(pdf)
                for i in range(len(ask) if len(x) else 0):
                    s, own = _best(np.round(x @ y[i], 5), keys, ask[i], k)
                    best_of[i] = _best(np.append(best_of[i][0], s), np.append(best_of[i][1], own), None, k)
            yield pd.DataFrame({"query": np.repeat(ask, [len(s) for s, _ in best_of]), "key": np.concatenate([o for _, o in best_of] or [np.empty(0, np.int64)]), "similarity": np.concatenate([s for s, _ in best_of] or [np.empty(0)])})

        return best(held.mapInPandas(scan, "query long, key long, similarity double"), ["query"], [F.desc("similarity"), F.asc("key")], k)
    parts, blocks = max(1, -(-held.count() // ROWS)), -(-n // QUERIES)
    left = held.withColumns({"part": F.pmod(F.xxhash64("key"), F.lit(parts)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = asked.withColumns({"block": F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))})

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            (keys, x), (ask, y) = _units(a), _units(b)
            for q, v in zip(ask, y):
                s, own = _best(np.round(x @ v, 5), keys, q, k)
                out.append(pd.DataFrame({"query": q, "key": own, "similarity": s}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "key": [], "similarity": []})

    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(meet, "query long, key long, similarity double")
    return best(met, ["query"], [F.desc("similarity"), F.asc("key")], k)


def _units(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors at length one, without those of no length."""
    if not len(pdf):
        return np.empty(0, np.int64), np.empty((0, 0))
    x = np.stack(pdf.v).astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    return pdf.key.to_numpy()[norm > 0], x[norm > 0] / norm[norm > 0, None]


def _best(s: np.ndarray, keys: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest numbers with their keys, smaller keys first at ties, without the own key."""
    if own is not None:
        s, keys = s[keys != own], keys[keys != own]
    if not len(s):
        return s, keys
    top = np.lexsort((keys, -s))[:k] if len(s) <= 4 * k else _top(s, keys, k)
    return s[top], keys[top]


def _top(s: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    least = np.partition(s, -k)[-k]
    near = np.flatnonzero(s >= least)
    return near[np.lexsort((keys[near], -s[near]))[:k]]
