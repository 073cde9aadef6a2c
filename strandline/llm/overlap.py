"""Problem 4: the same or almost the same text in an evaluation split and in the training split.

Rows are classed by their exact words. Evaluation classes are divided into shards, each a compressed full-text
index; training classes are streamed through its backward search. Their maximal matches with a text are merged
to spans, and the distinct three-word runs inside the matches, counted exactly, give the pair's similarity.

Which texts of a shard a training text is matched with comes from the index itself, which counts the runs that it
shares with each (routed=False: every training class goes through every shard, nothing is missed, and the work
grows as the product of both sides), or, by default, from the bands or prefixes that both share (nearby.py).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textcodes
from strandline.llm.common import source_name, split_name
from strandline.llm.fulltext import WordIndex
from strandline.llm.nearby import candidates, frequencies, signatures
from strandline.llm.plain import plain_all
from strandline.plans.staging import checked, staged

#: Evaluation texts of a shard, training texts that one task streams through it, and pairs that are matched in step.
SHARD, STREAM, PAIRS = 3_000, 6_000, 200_000
_LINKS = "train_cls long, eval_cls long, similarity double, longest_match int, matched_words int, spans int"


def _search(pdf: pd.DataFrame, threshold: float = 0.6) -> pd.DataFrame:
    """Links of one shard's evaluation texts (no partners) and training texts (with partners; an empty list
    of partners stands for all texts of the shard)."""
    held = pdf[pdf.partners.isna()].reset_index(drop=True)
    stream = pdf[pdf.partners.notna()].reset_index(drop=True)
    out = {c.split()[0]: [] for c in _LINKS.split(", ")}
    if len(held) and len(stream):
        ours = textcodes.word_hashes(plain_all(list(held.text)))
        index = WordIndex(*ours)
        runs_held = np.add.reduceat(np.append(textcodes.first_runs(*ours, 3), 0), ours[1][:-1]) * (np.diff(ours[1]) > 0)
        place = dict(zip(held.cls, range(len(held))))
        sizes = np.array([len(p) or len(held) for p in stream.partners])
        for _, part in stream.groupby((np.cumsum(sizes) - 1) // PAIRS):
            for c, v in _matched(index, runs_held, place, held.cls.to_numpy(), part, threshold).items():
                out[c].append(v)
    return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})


def _matched(index: WordIndex, runs_held: np.ndarray, place: dict, cls: np.ndarray, part: pd.DataFrame, threshold: float) -> dict[str, np.ndarray]:
    words, offsets = textcodes.word_hashes(plain_all(list(part.text)))
    first = textcodes.first_runs(words, offsets, 3)
    runs = np.diff(np.concatenate(([0], np.cumsum(first)))[offsets])
    if len(part.partners.iloc[0]):
        query = np.repeat(np.arange(len(part)), [len(p) for p in part.partners])
        text = np.array([place[c] for p in part.partners for c in p], np.int64)
    else:
        shared = index.shared_runs(words, offsets, first)
        query, text = np.nonzero((shared > 0) & (shared >= threshold * (runs[:, None] + runs_held[None, :] - shared) - 1e-9))
        other = part.cls.to_numpy()[query] != cls[text]
        query, text = query[other], text[other]
    found = index.maximal(words, offsets, query, text, first)
    both = found["inside"]
    similarity = both / np.maximum(runs[query] + runs_held[text] - both, 1)
    near = similarity >= threshold
    return {
        "train_cls": part.cls.to_numpy()[query][near], "eval_cls": cls[text][near], "similarity": similarity[near],
        "longest_match": found["longest"][near], "matched_words": found["covered"][near], "spans": found["spans"][near],
    }


def overlaps(rows: DataFrame, key: str = "record_id", text: str = "text", split: str = "split", source: str = "source_id", threshold: float = 0.6, routed: bool = True, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cross-split overlaps as (links between classes, members of classes).

    links: train_cls, eval_cls, similarity, longest_match, matched_words, spans; exact copies are a link of
    a class with itself. members: cls, the key, split_name, source_name, n_words. Rows of no known split, of
    null or blank text and of fewer than three words are members of no link. Repeated rows are members each.
    routed: a training class goes to the shards of evaluation classes with which it shares bands, which miss
    a pair by chance (1.5 % at similarity 0.6), or, if exact, prefixes, which miss none. Not routed: to all.
    """
    named = rows.select(F.col(key), split_name(split).alias("split_name"), source_name(source).alias("source_name"), F.col(text).alias("text"))
    named = named.filter(F.col("split_name").isin("train", "validation", "test") & (F.trim("text") != ""))
    signing = (*frequencies(named, "text"), threshold) if exact else ()
    # a class finds a text of its own by the text's hash: keys may be null or recur with other texts
    named = named.withColumn("text_hash", F.xxhash64("text"))
    signed = staged(signatures(named, "text", *signing).filter("n_runs > 0"))
    members = signed.select("cls", key, "split_name", "source_name", "n_words")
    sides = F.col("split_name") == "train"
    classes = signed.groupBy("cls").agg(F.first("keys").alias("keys"), F.max(sides).alias("is_left"), F.max(~sides).alias("is_right"), F.min("text_hash").alias("text_hash"))
    if routed:
        pairs = staged(candidates(classes, directed=True).select(F.col("a").alias("train_cls"), F.col("b").alias("eval_cls")))
        ends = pairs.select(F.col("train_cls").alias("cls")).union(pairs.select(F.col("eval_cls").alias("cls"))).distinct()
        speakers = signed.select("cls", "text_hash").join(ends, "cls").groupBy("cls").agg(F.min("text_hash").alias("text_hash"))
        shards = max(1, pairs.select("eval_cls").distinct().count() // SHARD)
        at = F.pmod(F.xxhash64("eval_cls"), F.lit(shards)).cast("int")
        partners = pairs.withColumn("shard", at).groupBy("shard", F.col("train_cls").alias("cls")).agg(F.collect_set("eval_cls").alias("partners"))
        evaluated = pairs.select(at.alias("shard"), F.col("eval_cls").alias("cls")).distinct()
    else:
        speakers = classes.select("cls", "text_hash")
        shards = max(1, classes.filter("is_right").count() // SHARD)
        partners = classes.filter("is_left").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "cls", F.array().cast("array<long>").alias("partners"))
        evaluated = classes.filter("is_right").select(F.pmod(F.xxhash64("cls"), F.lit(shards)).cast("int").alias("shard"), "cls")
    # one text of each class that takes part
    texts = staged(named.select("text_hash", "text").join(checked(staged(speakers)), "text_hash").select("cls", "text").dropDuplicates(["cls"]))
    parts = partners.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / STREAM).alias("parts"))
    stream = (
        partners.join(parts, "shard")
        .withColumn("part", F.pmod(F.xxhash64("cls", F.lit(7)), "parts"))
        .select("shard", "part", "cls", "partners")
        .join(texts, "cls")
    )
    held = (
        evaluated.join(parts, "shard")
        .select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "cls")
        .join(texts, "cls")
        .withColumn("partners", F.lit(None).cast("array<long>"))
    )
    near = stream.unionByName(held).groupBy("shard", "part").applyInPandas(lambda pdf: _search(pdf, threshold), _LINKS)
    sizes = members.groupBy("cls").agg(F.max(sides).alias("l"), F.max(~sides).alias("r"), F.max("n_words").alias("n"))
    copies = sizes.filter("l and r").select(
        F.col("cls").alias("train_cls"), F.col("cls").alias("eval_cls"), F.lit(1.0).alias("similarity"),
        F.col("n").alias("longest_match"), F.col("n").alias("matched_words"), F.lit(1).alias("spans"),
    )
    return near.unionByName(copies), members


def overlap_pairs(rows: DataFrame, key: str = "record_id", **options) -> DataFrame:
    """All pairs (key_a, key_b) of a training row and an evaluation row that overlap, the smaller key first.

    Rows of a null key are in no pair; the report counts them.
    """
    links, members = overlaps(rows, key, **options)
    members = members.filter(F.col(key).isNotNull())
    train = members.filter("split_name = 'train'").select(F.col("cls").alias("train_cls"), F.col(key).alias("k1"))
    held = members.filter("split_name <> 'train'").select(F.col("cls").alias("eval_cls"), F.col(key).alias("k2"))
    both = links.select("train_cls", "eval_cls").join(train, "train_cls").join(held, "eval_cls")
    return both.select(F.least("k1", "k2").alias(f"{key}_a"), F.greatest("k1", "k2").alias(f"{key}_b"))


def overlap_report(rows: DataFrame, key: str = "record_id", **options) -> DataFrame:
    """Per evaluation split and source: rows, rows that overlap with training, pairs, longest match in words.

    Pairs are counted from class sizes, not from expanded pairs. A null source is a row of its own.
    """
    links, members = overlaps(rows, key, **options)
    train = members.filter("split_name = 'train'").groupBy(F.col("cls").alias("train_cls")).agg(F.count(F.lit(1)).alias("copies"))
    linked = links.join(train, "train_cls").groupBy(F.col("eval_cls").alias("cls")).agg(F.sum("copies").alias("pairs"), F.max("longest_match").alias("longest"))
    held = members.filter("split_name <> 'train'").groupBy("cls", "split_name", "source_name").agg(F.count(F.lit(1)).alias("rows"))
    return (
        held.join(linked, "cls", "left")
        .groupBy(F.col("split_name").alias("split"), F.col("source_name").alias("source_id"))
        .agg(
            F.sum("rows").alias("n_rows"),
            F.sum(F.when(F.col("pairs").isNotNull(), F.col("rows")).otherwise(0)).alias("overlapping_rows"),
            F.coalesce(F.sum(F.col("rows") * F.col("pairs")), F.lit(0)).alias("n_pairs"),
            F.coalesce(F.max("longest"), F.lit(0)).alias("longest_match"),
        )
    )
