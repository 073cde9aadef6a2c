"""Problem 5: records that are versions of one another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textcodes
from strandline.llm.nearby import WORDS, candidates, frequencies, signatures, weights
from strandline.llm.plain import plain_all
from strandline.operators.graph import connected_components
from strandline.plans.staging import checked, staged

#: Least weighted similarity of a link. It must stay low: where a third of all texts tell one story, TF-IDF
#: gives its shingles a weight of ln 3 and each edit one of ln N, so that versions of plain similarity 0.6 have a weighted one of 0.1 to 0.2.
WEIGHTED_LEAST = 0.1


def _verify(pairs: DataFrame, table: np.ndarray, texts: int) -> DataFrame:
    """Weighted and plain Jaccard similarity of each pair's two texts."""
    shared = pairs.sparkSession.sparkContext.broadcast(table)

    def check(frames):
        table = shared.value
        for pdf in frames:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                both = plain_all([*part.text_a, *part.text_b])
                found, times, offsets = textcodes.distinct_runs(both, WORDS)
                w = weights(found, times, table, texts)
                m, out = len(part), np.zeros((2, len(part)))
                for i in range(m):
                    x, y = slice(offsets[i], offsets[i + 1]), slice(offsets[m + i], offsets[m + i + 1])
                    _, p, q = np.intersect1d(found[x], found[y], assume_unique=True, return_indices=True)
                    low = np.minimum(w[x][p], w[y][q]).sum()
                    out[0, i] = low / max(w[x].sum() + w[y].sum() - low, 1e-9)
                    out[1, i] = len(p) / max((x.stop - x.start) + (y.stop - y.start) - len(p), 1)
                yield pd.DataFrame({"a": part.a.to_numpy(), "b": part.b.to_numpy(), "weighted": out[0], "similarity": out[1]})

    return pairs.mapInPandas(check, "a long, b long, weighted double, similarity double")


def versions(rows: DataFrame, key: str, text: str, threshold: float = 0.6, weighted: float = WEIGHTED_LEAST, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records whose texts are similar, as (links between classes, members of classes).

    links: a, b, weighted, similarity, with a <> b: candidates of at least the weighted (TF-IDF) Jaccard
    similarity asked for, and of these the ones of at least the plain one. exact: candidates come from
    prefixes, which miss no pair of the threshold, instead of bands. members: cls and key, one row for each key; records of
    equal words share a class. A key that recurs counts once, with its least class if its texts differ.
    Null keys, null and empty texts and texts of fewer than three words are in no link and no class.
    """
    named = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text <> ''")
    table, n = frequencies(named, "text")
    # a class finds a text of its own by the text's hash: a key may recur with other texts
    named = named.withColumn("text_hash", F.xxhash64("text"))
    signed = staged(signatures(named, "text", table, n, threshold if exact else None).filter("n_runs > 0"))
    members = staged(signed.groupBy("key").agg(F.min("cls").alias("cls")))
    classes = signed.groupBy("cls").agg(F.first("keys").alias("keys")).withColumns({"is_left": F.lit(True), "is_right": F.lit(True)})
    pairs = staged(candidates(classes))
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    speakers = staged(signed.select("cls", "text_hash").join(wanted, "cls").groupBy("cls").agg(F.min("text_hash").alias("text_hash")))
    texts = staged(named.select("text_hash", "text").join(checked(speakers), "text_hash").dropDuplicates(["cls"]).select("cls", "text"))
    with_texts = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    links = _verify(with_texts, table, n).filter((F.col("weighted") >= weighted) & (F.col("similarity") >= threshold))
    return staged(links), members


def version_pairs(rows: DataFrame, key: str, text: str, threshold: float = 0.6, **options) -> DataFrame:
    """All pairs (key_a, key_b) of different keys that are versions, smaller key first; equal texts too."""
    links, members = versions(rows, key, text, threshold, **options)
    a, b = members.select(F.col("cls").alias("a"), F.col("key").alias("ka")), members.select(F.col("cls").alias("b"), F.col("key").alias("kb"))
    near = links.select("a", "b").join(a, "a").join(b, "b").select("ka", "kb")
    # keys of one class: only classes of several keys are joined
    several = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cls")
    many = members.join(several, "cls")
    same = many.select("cls", F.col("key").alias("ka")).join(many.select("cls", F.col("key").alias("kb")), "cls").filter("ka < kb").select("ka", "kb")
    return near.union(same).select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()


def version_groups(rows: DataFrame, key: str, text: str, threshold: float = 0.6, **options) -> DataFrame:
    """One row for each key: its class, its group (connected through links), the group's size, the number of
    classes its own is linked to and the copies of its class. A key without versions is a group of one."""
    links, members = versions(rows, key, text, threshold, **options)
    groups = connected_components(links)
    ends = links.select(F.col("a").alias("cls")).union(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    named = (
        copies.join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left")
        .join(ends, "cls", "left")
        .select("cls", F.coalesce("component", "cls").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies")
    )
    sizes = named.groupBy("group_id").agg(F.sum("copies").alias("group_size"))
    return members.join(named.join(sizes, "group_id"), "cls").select(F.col("key").alias(key), F.col("cls").alias("class_id"), "group_id", "group_size", "n_links", "copies")
