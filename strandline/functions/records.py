"""Expressions that put records together: text projections, messages, lists, JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandline.functions.text import col, collapsed


def distinct_parts(*parts: str | Column, sep: str = "\n\n") -> Column:
    """The trimmed parts that are not empty, each once, joined; null if there is none."""
    kept = F.array_distinct(F.filter(F.array(*[F.trim(col(p)) for p in parts]), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(kept) > 0, F.array_join(kept, sep))


def labelled_parts(**parts: str) -> Column:
    """"Title: … | Body: …" without parts whose collapsed text an earlier part has."""
    named = F.array(*[F.struct(F.lit(k.capitalize()).alias("k"), F.trim(v).alias("v"), collapsed(v).alias("c")) for k, v in parts.items()])
    kept = F.filter(named, lambda x, i: x["v"].isNotNull() & (x["v"] != "") & ~F.exists(F.slice(named, F.lit(1), i), lambda y: y["c"].eqNullSafe(x["c"])))
    return F.array_join(F.transform(kept, lambda x: F.concat(x["k"], F.lit(": "), x["v"])), " | ")


def training_text(title: str | Column, text: str | Column) -> Column:
    """The text that a document is trained on: its title on a line of its own, a blank line, its text; null
    without a text."""
    head = F.when(F.trim(col(title)) != "", F.concat(F.lit("Title: "), F.trim(col(title)), F.lit("\n\n"))).otherwise("")
    return F.when(F.trim(col(text)) != "", F.concat(head, F.trim(col(text))))


def query_text(c: str | Column) -> Column:
    """The prefixed form in which an interest is encoded; null if it is blank."""
    x = F.trim(col(c))
    return F.when(x != "", F.concat(F.lit("query: "), x))


def chat_messages(system: str, user: str | Column, answer: Column) -> Column:
    """A system, user and assistant message as a JSON array; the answer is JSON text inside it."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.array(message("system", F.lit(system)), message("user", col(user)), message("assistant", F.to_json(answer))))


def listed(c: str | Column, sep: str = r"[|\n]") -> Column:
    """Trimmed, non-empty, distinct items of a separated list."""
    return F.array_distinct(F.filter(F.transform(F.split(col(c), sep), lambda x: F.trim(x)), lambda x: x != ""))


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first JSON object inside a text, as compact JSON with sorted keys; null if there is none.

    Python is needed to find where an object ends."""
    decoder = json.JSONDecoder()

    def find(text):
        at = text.find("{") if text else -1
        while at >= 0:
            try:
                found, _ = decoder.raw_decode(text, at)
                return json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            except (ValueError, RecursionError):
                at = text.find("{", at + 1)
        return None

    return texts.map(find)


def repaired_keys(c: str | Column, wanted: list[str]) -> Column:
    """A JSON object whose keys differ from the wanted ones in case only, with the wanted keys; null if one is
    missing, unknown or there twice. Values are kept as their JSON text."""
    have = F.from_json(col(c), "map<string,string>")
    low = F.transform(F.map_keys(have), F.lower)
    names = F.array(*[F.lit(w) for w in sorted(wanted)])
    fits = F.array_sort(low) == F.array_sort(F.transform(names, F.lower))
    pairs = F.transform(names, lambda w: F.struct(w.alias("k"), F.element_at(F.map_from_entries(F.transform(F.map_entries(have), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))), F.lower(w)).alias("v")))
    return F.when(fits, F.map_from_entries(pairs))
