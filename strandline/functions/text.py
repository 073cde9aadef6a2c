"""Scalar functions on text as Spark expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often, or inside which lambda, it stands there."""
    return F.transform(F.array(value), use)[0]


def trimmed_lower(c: str | Column) -> Column:
    """Without blanks at the ends, in lower case."""
    return F.lower(F.trim(col(c)))


def collapsed(c: str | Column) -> Column:
    """Lower case, every run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[\s\p{Z}]+", " "))


def words(c: str | Column, least: int = 1) -> Column:
    """Lower-case words, of at least so many characters."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD if least == 1 else r"[\p{L}\p{N}_]{%d,}" % least), F.lit(0))


def word_key(c: str | Column) -> Column:
    """The words joined by single blanks: what names are compared by."""
    return F.array_join(words(c), " ")


@F.pandas_udf(StringType())
def entity_key(texts: pd.Series) -> pd.Series:
    """Compatibility-normalised, case-folded, with single blanks between words. Python is needed for the
    compatibility forms, which no built-in function knows."""
    folded = texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())
    return folded.str.replace(r"[^\w؀-ۿ]+", " ", regex=True).str.strip()


def sorted_names(c: str | Column) -> Column:
    """The values of an array in the order of their words in lower case, then of their spelling; without nulls."""
    keyed = F.transform(F.filter(col(c), lambda v: v.isNotNull()), lambda v: F.struct(word_key(v).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def fingerprint(*parts: str | Column) -> Column:
    """SHA-256 of the parts, joined by a blank, in lower case and with white space collapsed."""
    return F.sha2(collapsed(F.concat_ws(" ", *[F.coalesce(col(p), F.lit("")) for p in parts])), 256)


def stable_split(c: str | Column) -> Column:
    """train, validation or test in the proportions 80/10/10, a function of the id alone."""
    bucket = F.conv(F.substring(F.sha2(col(c).cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 80, "train").when(bucket < 90, "validation").otherwise("test")


def script_label(c: str | Column) -> Column:
    """Arabic, Latin, mixed or none, by the letters a text has."""
    arabic, latin = col(c).rlike("[\\u0600-\\u06ff]"), col(c).rlike("[A-Za-z]")
    return F.when(arabic & latin, "mixed").when(arabic, "Arabic").when(latin, "Latin").otherwise("none")


def occurrences(text: str | Column, part: str | Column) -> Column:
    """How often a non-empty part occurs in a text, without overlaps."""
    t, p = col(text), col(part)
    return F.when(F.length(p) > 0, ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("long"))


def first_offset(text: str | Column, part: str | Column) -> Column:
    """Offset of the first literal occurrence, null if there is none or the part is empty."""
    at = F.instr(col(text), col(part)) if not isinstance(part, str) else F.expr(f"instr(`{text}`, `{part}`)")
    return F.when((F.length(col(part)) > 0) & (at > 0), at - 1)


def around(text: str | Column, start: Column, end: Column, reach: int = 180) -> Column:
    """The characters from reach before start to reach after end."""
    lo = F.greatest(F.lit(0), start - reach)
    return F.substring(col(text), lo + 1, end + reach - lo)


def parsed_date(c: str | Column) -> Column:
    """A date from the usual formats, tried in order; null for none. Zoned times give the date as written."""
    x = F.trim(col(c))
    iso = F.regexp_extract(x, r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1)
    slashed = F.when(x.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.concat(F.substring(x, 7, 4), F.lit("-"), F.substring(x, 4, 2), F.lit("-"), F.substring(x, 1, 2)))
    return F.coalesce(F.try_to_date(F.when(iso != "", iso), "yyyy-MM-dd"), F.try_to_date(slashed, "yyyy-MM-dd"), F.try_to_date(x, "MMMM d, yyyy"), F.try_to_date(x, "MMMM d yyyy"), F.try_to_date(x, "d MMMM yyyy"))


def dated(c: str | Column, revised: str | Column) -> Column:
    """A struct of date and date_kind: the publication date where one is stated, else the day of the revision."""
    stated = parsed_date(c)
    fallback = parsed_date(F.regexp_extract(col(revised).cast("string"), r"^(\d{4}-\d{2}-\d{2})", 1))
    kind = F.when(stated.isNotNull(), "publication_date").when(fallback.isNotNull(), "revision_date")
    return F.struct(F.coalesce(stated, fallback).alias("date"), kind.alias("date_kind"))


def windows(array: str | Column, size: int, stride: int) -> Column:
    """Slices of an array, size long, stride apart; the last may be shorter; none for an empty array."""
    def cut(a: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(a) - size) / F.lit(float(stride))).cast("int"))
        return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(a, i * stride + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))

    return let(col(array), cut)


def without_markup(c: str | Column) -> Column:
    """Wiki text as prose: cut at its closing sections, without category and file links, templates, link and
    emphasis marks and empty lines. Templates are removed from the inside out, however deep they are nested."""
    x = F.regexp_replace(col(c), r"(?ims)^==+\s*(?:sources|related news|external links|references|مصادر|المصادر)\s*==+.*", "")
    x = F.regexp_replace(x, r"(?i)\[\[(?:Category|File|Image|تصنيف|ملف):[^\]]*\]\]", "")
    # no template is nested deeper than there are openings
    x = F.aggregate(F.sequence(F.lit(0), F.regexp_count(x, F.lit(r"\{\{"))), x, lambda t, _: F.regexp_replace(t, r"\{\{[^{}]*\}\}", ""))
    x = F.regexp_replace(x, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    x = F.regexp_replace(x, r"'{2,5}|<[^>]+>|(?m)^=+\s*|\s*=+$", "")
    return F.array_join(F.filter(F.transform(F.split(x, r"\n"), F.trim), lambda y: y != ""), "\n")
