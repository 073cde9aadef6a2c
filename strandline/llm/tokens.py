"""Problem 3: tokens of each text under an existing tokenizer, and totals over cubes."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import language_name, source_name

TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: how this family of byte-level vocabularies divides a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose numbers of tokens a worker keeps.
_KNOWN = 500_000


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer, once for each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _counter(path: str):
    """Counts the tokens of texts, which are sums over the pieces that the pattern divides a text into.

    Pieces recur, so that each new one of a batch is encoded once, all of them together, and kept.
    """
    import regex

    pieces, coder, known = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall, encoding(path), {}

    def count(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            found = pieces(text)
            try:
                out.append(sum(map(known.__getitem__, found)))
            except KeyError:
                if len(known) > _KNOWN:
                    known.clear()
                new = [p for p in dict.fromkeys(found) if p not in known]
                known.update(zip(new, map(len, coder.encode_ordinary_batch(new, num_threads=1))))
                out.append(sum(map(known.__getitem__, found)))
        return out

    return count


def token_count(text: str | Column, path: str = TOKENIZER) -> Column:
    """The number of tokens of a text; 0 for null and empty ones. Special tokens' names count as text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path)
        for texts in batches:
            yield pd.Series(counter([t or "" for t in texts]), dtype="int64")

    return count(text)


def token_table(rows: DataFrame, sources: DataFrame, key: str = "record_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """One row for each row: key, source_id, language, domain, n_tokens, n_chars.

    Sources are trimmed and lower-cased, languages have one name each, the domain is the source's; what is
    null or not in the manifest is unknown. Repeated rows are counted each.
    """
    counted = rows.select(F.col(key), source_name("source_id").alias("source_id"), language_name("language").alias("language"), token_count(text, path).alias("n_tokens"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))
    domains = sources.select(source_name("source_id").alias("source_id"), "domain").dropDuplicates(["source_id"])
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    return counted.join(domains, "source_id", "left").select(key, unknown("source_id").alias("source_id"), "language", unknown("domain").alias("domain"), "n_tokens", "n_chars")


def token_cube(rows: DataFrame, sources: DataFrame, **options) -> DataFrame:
    """Tokens, characters and texts over every combination of source, language and domain; level says which
    columns are summed over (bits 4, 2 and 1), and those columns read "all"."""
    cube = token_table(rows, sources, **options).cube("source_id", "language", "domain")
    summed = cube.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_chars").alias("n_chars"))
    names = ("source_id", "language", "domain")
    return summed.select(*[F.coalesce(c, F.lit("all")).alias(c) for c in names], "level", "n_texts", "n_tokens", "n_chars")
