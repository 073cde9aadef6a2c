"""Candidate pairs of similar texts: consistent weighted sampling over shingles, banded.

The weights of some bands are TF-IDF, of the others all equal. Boilerplate weighs little in the first, so it
brings few strangers together; the second find the versions of a story that a large part of all texts tells,
whose own shingles TF-IDF takes for boilerplate. There the first add next to nothing, so the second are as many
as the threshold needs by themselves: a pair of plain similarity 0.6 is missed with a chance of 1.5 %. A pair can
be missed only by chance of the bands; prefixes instead of bands miss none, at the cost of more candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import sketch, textcodes
from strandline.llm.plain import plain_all
from strandline.plans.staging import staged

#: Words of a shingle; samples of a band; bands in which two texts must agree to be compared.
WORDS, ROWS, AGREE = 3, 3, 2
#: Bands of TF-IDF weights and of equal weights.
WEIGHTED, EQUAL = 12, 26
#: A bucket with more classes than this is divided by a second band before pairs are formed.
CROWD = 64
#: Shingles that a task holds at once.
_HELD = 2_000_000


def frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts the shingles of each cell occur, over all texts, and the number of texts.

    The table has sketch.CELLS cells for any input, so that it can be sent to every task: 4 MB.
    """

    def count(batches):
        cells, texts = np.zeros(sketch.CELLS, np.int64), 0
        for batch in batches:
            values = [t for t in batch.column(0).to_pylist() if t]
            for a, b in textcodes.chunks(values):
                found, _, offsets = textcodes.distinct_runs(plain_all(values[a:b]), WORDS)
                cells += np.bincount(sketch.cell(found), minlength=sketch.CELLS)
                texts += int((np.diff(offsets) > 0).sum())
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(cells[at], texts), pa.int64())})

    table = df.select(text).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = table["cell"].to_numpy(), table["n"].to_numpy()
    out = np.zeros(sketch.CELLS, np.uint32)
    out[cell[cell >= 0]] = np.minimum(n[cell >= 0], 2**32 - 1)
    return out, int(n[cell < 0].sum())


def weights(shingles: np.ndarray, times: np.ndarray, table: np.ndarray, texts: int) -> np.ndarray:
    """TF-IDF: occurrences in the text times the inverse document frequency."""
    return times * sketch.idf(table[sketch.cell(shingles)].astype(np.float64), texts)


def digests(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One number for each sequence of words: equal for texts with the same words in the same order."""
    sizes = np.diff(offsets)
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], sizes)
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        with np.errstate(over="ignore"):
            values = textcodes.mix(hashes ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
            out[full] = textcodes.mix(np.add.reduceat(values, offsets[:-1][full]))
    return out


def prefix_keys(found: np.ndarray, sizes: np.ndarray, table: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of each text that any text of at least this similarity shares two of, and their offsets.

    Two sets of similarity t have at least t |x| shingles in common, so that of the |x| - t |x| + 2 rarest of
    either, in one order of all shingles, two are in both. A text of one shingle has it twice, as two keys.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    order = np.lexsort((found, table[sketch.cell(found)], owner))
    place = np.arange(len(found)) - np.repeat(begin, sizes)
    most = np.minimum(sizes, sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 2)
    keep = place < most[owner]
    keys, of = textcodes.mix(found[order[keep]]), owner[keep]
    lone = np.flatnonzero(sizes == 1)
    keys, of = np.concatenate((keys, textcodes.mix(found[begin[lone]] ^ np.uint64(1 << 50)))), np.concatenate((of, lone))
    by = np.argsort(of, kind="stable")
    return keys[by], np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(sizes)))))


def signatures(df: DataFrame, text: str, table: np.ndarray | None = None, texts: int = 0, exact: float | None = None) -> DataFrame:
    """The other columns of df with each text's class, number of distinct shingles, of words and keys.

    Texts with the same words in the same order have one class. Texts of fewer than three words, empty and
    null ones have no keys and count 0 words. Without a table of document frequencies there are only bands of
    equal weights. exact: keys are prefixes for that similarity instead of bands (a table is needed).
    """
    kept = [c for c in df.columns if c != text]
    shared = df.sparkSession.sparkContext.broadcast(table)
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def sign(batches):
        table = shared.value
        held: list = []
        for batch in batches:
            rest = batch.select(kept)
            values = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for a, b in textcodes.chunks(values):
                hashes, offsets = textcodes.word_hashes(plain_all(values[a:b]))
                held.append((rest.slice(a, b - a), digests(hashes, offsets), *textcodes.counted_runs(hashes, offsets, WORDS), np.diff(offsets)))
                if sum(len(h[2]) for h in held) > _HELD:
                    yield flush(held, table)
                    held = []
        if held:
            yield flush(held, table)

    def flush(held, table):
        found = np.concatenate([h[2] for h in held])
        sizes = np.concatenate([np.diff(h[4]) for h in held])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        if exact is not None:
            keys, ends = prefix_keys(found, sizes, table, exact)
        else:
            drawn, bands = sketch.equal_samples(found, offsets, ROWS * EQUAL), EQUAL
            if table is not None:
                times = np.concatenate([h[3] for h in held])
                drawn, bands = np.hstack((sketch.samples(found, weights(found, times, table, texts), offsets, ROWS * WEIGHTED), drawn)), EQUAL + WEIGHTED
            keys = sketch.band_keys(drawn, bands, ROWS)[sizes > 0].reshape(-1)
            ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0))))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.view(np.int64), pa.int64()))
        rest = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
        columns = [rest.column(c).combine_chunks() if rest.num_rows else pa.array([], rest.schema.field(c).type) for c in kept]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        words = np.where(sizes > 0, np.concatenate([h[5] for h in held]), 0)
        columns += [pa.array(np.concatenate([h[1] for h in held]).view(np.int64), pa.int64()), pa.array(sizes, pa.int32()), pa.array(words, pa.int32()), lists]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, "cls", "n_runs", "n_words", "keys"])

    return df.mapInArrow(sign, f"{types}, cls long, n_runs int, n_words int, keys array<long>")


def candidates(classes: DataFrame, directed: bool = False) -> DataFrame:
    """Pairs (a, b) of classes that share two buckets, a of the left and b of the right side, each pair once.

    classes: cls, keys, is_left, is_right. Of two classes that are both on both sides, both orders are pairs
    if directed, else the one with the smaller class first. What is alone in its bucket goes no further: buckets are
    counted first, combined before the shuffle, or, if directed, only the right side's keys are sent ahead, which
    are few. A crowded bucket is divided by every other band of its members, so that its pairs are those that
    agree in two bands.
    """
    keyed = classes.select("cls", "is_left", "is_right", F.explode("keys").alias("key"))
    if directed:
        left = staged(keyed.filter("is_left").join(keyed.filter("is_right").select("key").distinct(), "key", "left_semi"))
        right = keyed.filter("is_right and not is_left").join(left.select("key").distinct(), "key", "left_semi")
        keyed = staged(left.unionByName(right))
    met = (
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("is_left").alias("l"), F.max("is_right").alias("r"))
        .filter("n > 1 and l and r")
        .select("key", "n")
    )
    # few are left: kept, so that the two ways from here do not join twice
    members = staged(keyed.join(met, "key"))
    slim = ["cls", "is_left", "is_right", "key"]
    rest, crowded = members.filter(F.col("n") <= CROWD).select(*slim), members.filter(F.col("n") > CROWD).select(*slim)
    if not crowded.isEmpty():
        both = crowded.join(classes.select("cls", F.explode("keys").alias("other")), "cls").filter("other <> key")
        rest = rest.union(both.select("cls", "is_left", "is_right", F.xxhash64("key", "other").alias("key")))
    left = rest.filter("is_left").select(F.col("cls").alias("a"), F.col("is_right").alias("ar"), "key")
    right = rest.filter("is_right").select(F.col("cls").alias("b"), F.col("is_left").alias("bl"), "key")
    return left.join(right, "key").filter("a <> b" if directed else "a <> b and (a < b or not (ar and bl))").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= AGREE).select("a", "b")
