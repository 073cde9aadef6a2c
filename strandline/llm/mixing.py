"""Problem 7: sources mixed to target shares of all tokens."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.textcodes import mix
from strandline.llm.tokens import TOKENIZER, token_count
from strandline.plans.staging import staged

#: Draws of a block, tokens of an output shard, shards of a mix at least (of no less than a block each), and texts
#: of one part of a source, in which they are ranked.
BLOCK, SHARD_TOKENS, LEAST_SHARDS, RANKED = 4, 1_000_000, 8, 200_000
SEED = 20240


def quotas(targets: DataFrame, amounts: DataFrame, total: int | None = None) -> DataFrame:
    """mix_id, source, target_share, max_repeats, available tokens, quota of tokens, whole passes and the rest.

    The mix is as large as it can be with every source at its share and within its repeats, or has so many
    tokens in total, less what scarce sources cannot give; sources that have no tokens are left out of the
    shares' sum and get nothing. Negative or null shares count as 0.
    """
    known = targets.select("mix_id", "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    whole = Window.partitionBy("mix_id")
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    found = known.join(amounts, "source", "left").fillna({"available": 0, "n_docs": 0})
    norm = F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(whole)
    shared = found.withColumn("share", F.when(usable, norm).otherwise(F.lit(0.0)))
    most = F.min(F.when(usable, F.col("max_repeats") * F.col("available") / F.col("share"))).over(whole)
    wanted = F.col("share") * (most if total is None else F.lit(float(total)))
    sized = shared.withColumn("quota", F.when(usable, F.least(wanted, F.col("max_repeats") * F.col("available"))).otherwise(F.lit(0.0)))
    passes = F.when(usable, F.least(F.floor(F.col("quota") / F.col("available") + 1e-9), F.col("max_repeats").cast("long"))).otherwise(F.lit(0))
    return sized.withColumn("passes", passes).withColumn("rest", F.greatest(F.col("quota") - F.col("passes") * F.coalesce("available", F.lit(0)), F.lit(0.0)))


def leaf(blocks: np.ndarray, shards: int, shard: int, seed: int) -> np.ndarray:
    """How many of each source's blocks go to one shard: the path from the tree's root to its leaf.

    Each node divides its blocks between two halves of its shards by a multivariate hypergeometric draw whose
    generator is seeded by the node, so that every task that passes a node draws the same.
    """
    lo, hi, here = 0, shards, blocks.astype(np.int64)
    while hi - lo > 1:
        middle = (lo + hi) // 2
        total = int(here.sum())
        take = total * (middle - lo) // (hi - lo)
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(here, take, method="marginals") if total else here
        if shard < middle:
            hi, here = middle, draw
        else:
            lo, here = middle, here - draw
    return here


def permuted(place: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Where a seeded permutation of the numbers below size takes each place, without a sort or a table.

    Four Feistel rounds over the least even number of bits that holds size; what falls outside goes on.
    """
    half = np.array([max(1, (int(n - 1).bit_length() + 1) // 2) for n in size], np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, seed = place.astype(np.uint64), seed.astype(np.int64).view(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m = half[todo], low[todo]
        a, b = out[todo] >> h, out[todo] & m
        for k in range(4):
            a, b = b, a ^ (mix(mix(seed[todo] ^ np.uint64(k)) ^ b) & m)
        out[todo] = a << h | b
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def chosen(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen texts, quotas). Chosen: mix_id, source, doc_id, tokens, uses, and the number of its first and last draw.

    Each source gives all its texts in so many whole passes, then the first texts in the order of a hash up to
    the rest of its quota, and one more, the text that comes nearest to what is still lacking. Texts of no
    tokens and of no or no wanted source are never chosen. A key that recurs is a text each time.
    """
    counted = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), token_count(text, path).alias("tokens"))
    wanted = targets.select("source").distinct()
    items = staged(counted.join(wanted, "source", "left_semi").filter("tokens > 0"))
    amounts = staged(items.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("n_docs")))
    plan = staged(quotas(targets, amounts, total))
    # tokens and texts before each text in its source: sums over parts of the hash, then inside a part
    most = amounts.agg(F.max("n_docs")).first()[0] or 1
    bits = max(4, (most // RANKED).bit_length())
    hashed = items.withColumn("h", F.xxhash64("doc_id", F.lit(SEED))).withColumn("part", F.shiftrightunsigned("h", 64 - bits))
    sizes = hashed.groupBy("source", "part").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("source", "part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "tokens")
    ranked = hashed.join(before, ["source", "part"]).select(
        "source", "doc_id", "tokens",
        (F.col("t0") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("start"),
        (F.col("n0") + F.row_number().over(inside) - 1).alias("place"),
    )
    open_ = (F.col("rest") > 0) & (F.col("passes") < F.col("max_repeats"))
    used = ranked.join(plan.filter("quota > 0").select("mix_id", "source", "passes", "rest", "max_repeats", "n_docs"), "source")
    used = staged(used.withColumns({"extra": open_ & (F.col("start") + F.col("tokens") / 2 <= F.col("rest")), "open": open_}).drop("max_repeats"))
    given = used.groupBy("mix_id", "source").agg(F.coalesce(F.sum(F.when(F.col("extra"), F.col("tokens"))), F.lit(0)).alias("given"), F.count_if("extra").alias("n_extra"))
    lacking = used.join(given, ["mix_id", "source"]).filter(F.col("open") & ~F.col("extra")).withColumn("off", F.abs(F.col("rest") - F.col("given") - F.col("tokens")))
    filler = lacking.filter(F.col("off") < F.col("rest") - F.col("given")).groupBy("mix_id", "source").agg(F.min_by("place", F.struct("off", "place")).alias("filler"), F.first("n_extra").alias("n_extra"))
    both = used.join(filler, ["mix_id", "source"], "left")
    # the number of a text's draw in the last, partial pass
    last = F.when(F.col("extra"), F.col("place")).when(F.col("place") == F.col("filler"), F.col("n_extra"))
    taken = both.withColumn("last", last).withColumn("uses", F.col("passes") + F.col("last").isNotNull().cast("long")).filter("uses > 0")
    # kept: the draws are numbered from sums over it
    return staged(taken.select("mix_id", "source", "doc_id", "tokens", "uses", "place", "last", "passes", "n_docs")), plan


def shares(taken: DataFrame, plan: DataFrame) -> DataFrame:
    """For each mix and source: target and reached share, tokens, texts, draws and most uses of a text."""
    got = taken.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.sum("uses").alias("draws"), F.max("uses").alias("most_uses"))
    both = plan.select("mix_id", "source", "target_share", "max_repeats", "available").join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "n_docs", "draws", "most_uses"])
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return both.withColumn("reached_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))


def placed(taken: DataFrame) -> DataFrame:
    """The draws of each mix and the output shard that each goes to: mix_id, shard, source, doc_id, place, pass, tokens.

    A source's draws, pass after pass in its hash order, are cut into blocks, whose numbers are permuted. A
    splitting tree gives each shard exact numbers of each source's blocks; the shard takes the next of them.
    """
    draws = taken.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), "uses")))
    number = F.when(F.col("pass") <= F.col("passes"), (F.col("pass") - 1) * F.col("n_docs") + F.col("place")).otherwise(F.col("passes") * F.col("n_docs") + F.col("last"))
    numbered = draws.withColumn("block", F.floor(number / BLOCK))
    amounts = taken.groupBy("mix_id", "source").agg(F.ceil(F.sum("uses") / BLOCK).alias("blocks"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    shards = F.greatest(F.lit(1), F.least(F.sum("blocks"), F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.sum("tokens") / SHARD_TOKENS)))).cast("int")
    leaves = amounts.groupBy("mix_id").agg(shards.alias("n_shards"), F.array_sort(F.collect_list(F.struct("source", "blocks"))).alias("sources"))
    leaves = leaves.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1))).repartition("mix_id", "shard")

    def draw(frames):
        for pdf in frames:
            out = []
            for m, n, names, shard in zip(pdf.mix_id, pdf.n_shards, pdf.sources, pdf.shard):
                got = leaf(np.array([x["blocks"] for x in names]), n, shard, zlib.crc32(f"{SEED}:{m}".encode()))
                out += [(m, x["source"], shard, int(k), int(x["blocks"])) for x, k in zip(names, got) if k]
            yield pd.DataFrame(out, columns=["mix_id", "source", "shard", "k", "blocks"])

    @F.pandas_udf("long")
    def block(at: pd.Series, size: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series(permuted(at.to_numpy(), size.to_numpy(), seed.to_numpy()))

    # every shard's blocks of a source are, in the permutation, the next after those of the shards before it
    given = leaves.select("mix_id", "n_shards", "sources", "shard").mapInPandas(draw, "mix_id string, source string, shard int, k long, blocks long")
    upto = F.sum("k").over(Window.partitionBy("mix_id", "source").orderBy("shard"))
    spread = given.withColumn("upto", upto).select("mix_id", "source", "shard", "blocks", F.explode(F.sequence(F.col("upto") - F.col("k"), F.col("upto") - 1)).alias("at"))
    spread = spread.select("mix_id", "source", "shard", block("at", "blocks", F.xxhash64("mix_id", "source", F.lit(SEED))).alias("block"))
    return numbered.join(spread, ["mix_id", "source", "block"]).select("mix_id", "shard", "source", "doc_id", "place", "pass", "tokens")


def drawn(taken: DataFrame) -> DataFrame:
    """The chosen texts as the shards hold them: mix_id, source, doc_id, tokens, place, uses over all shards."""
    return placed(taken).groupBy("mix_id", "source", "doc_id", "tokens", "place").agg(F.count(F.lit(1)).alias("uses"))


def shards(taken: DataFrame, plan: DataFrame) -> DataFrame:
    """The draws of each mix in output shards, shuffled in each: mix_id, shard, position, source, doc_id, pass, tokens."""
    local = Window.partitionBy("mix_id", "shard").orderBy(F.xxhash64("doc_id", "pass", F.lit(SEED)), "source", "doc_id", "pass")
    return placed(taken).withColumn("position", F.row_number().over(local)).select("mix_id", "shard", "position", "source", "doc_id", "pass", "tokens")
