"""Problem 2: fields whose text is not in its plain form, and their plain forms."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.plain import letter_pairs, log_scores, plain, suspicious

_BLANKS = re.compile(r"[ \t\r\n\f\v]+")


def letter_scores(texts: DataFrame) -> dict[tuple[str, str], float]:
    """Log-likelihoods of letter pairs, counted over all texts (one column of strings).

    Only letters of five scripts' blocks are paired, with letters of their own script: fewer than half a
    million pairs whatever the number of texts.
    """

    def count(batches):
        for batch in batches:
            pairs = letter_pairs([t for t in batch.column(0).to_pylist() if t])
            a, b = [k[0] for k in pairs], [k[1] for k in pairs]
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "n": pa.array(list(pairs.values()), pa.int64())})

    counted = texts.mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return log_scores(sorted(tuple(r) for r in counted.collect()))


def plain_fields(fields: DataFrame, scores: dict[tuple[str, str], float]) -> DataFrame:
    """record_key, field, plain_values and changed for rows of (record_key, field, vals: array of strings).

    changed: a value differs from its plain form other than in blanks. Null lists stay null and are not
    changed, null values inside a list stay null. Repeated rows give a row each.
    """
    sent = fields.sparkSession.sparkContext.broadcast(scores)

    def work(batches):
        scores = sent.value
        for batch in batches:
            known: dict[str, str] = {}
            lists = batch.column(2)
            flat = [t or "" for t in lists.flatten().to_pylist()]
            dirty, fixed = {}, suspicious(flat) if flat else []
            for i, bad in enumerate(fixed):
                if bad and (p := plain(flat[i], scores, known)) != flat[i]:
                    dirty[i] = p
            out, changed, at = [], [], 0
            for values in lists.to_pylist():
                if values is None:
                    out.append(None)
                    changed.append(False)
                    continue
                mine = [(v, dirty.get(at + k, v)) for k, v in enumerate(values)]
                at += len(values)
                out.append([p for _, p in mine])
                changed.append(any(v is not None and _BLANKS.sub(" ", v).strip() != _BLANKS.sub(" ", p).strip() for v, p in mine))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string())), pa.array(changed)], names=["record_key", "field", "plain_values", "changed"])

    return fields.select("record_key", "field", "vals").mapInArrow(work, "record_key string, field string, plain_values array<string>, changed boolean")


def text_fields(ranking: DataFrame, examples: DataFrame) -> DataFrame:
    """The fields of problem 2: one row for each article body and each list of country or organisation names."""
    one = lambda key, name, vals: [F.col(key).alias("record_key"), F.lit(name).alias("field"), vals.alias("vals")]
    bodies = ranking.select(*one("article.article_id", "body", F.array(F.col("article.body"))))
    names = [examples.select(*one("example_id", n, F.col(f"labels.{n}"))) for n in ("countries", "organizations")]
    return bodies.union(names[0]).union(names[1])


def all_values(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Every text that letter pairs are counted over: the fields' values and the catalogue's names."""
    values: Column = F.explode("vals")
    names = entities.select(F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    return fields.select(values.alias("value")).union(names)
