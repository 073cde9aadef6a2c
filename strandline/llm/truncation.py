"""Problem 8: texts that were cut off before their end, in SQL.

Word trigrams (digits masked) are counted over all texts, apart for those that another word follows, those that
a closing mark follows and those at the end of a line without one. Each text's final trigram is joined to these
counts, backed off to its last two words, its last word and any word where it is rare. The share of its uses
that end as this text does, its own use aside, decides: a place where words are frequent inside and hardly ever
at such an end is no end of a text, closing mark or not. That words may end without a mark, only the ends of
lines inside texts can show: at the texts' own ends they stand where texts were cut, too.

Before that, a text's tail is made ready: what a cut leaves behind (an ellipsis, a broken entity, tag or escape)
is taken off, and so is a sign-off line, which is known by its first word: one that hardly begins any line but
last ones. Texts of one line that begin with a heading ("FLASH: …") have no lines inside; they are counted apart
for each heading, their own ends included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandline.plans.staging import staged

# Fixed values, as regular expressions: closing marks, remains of a cut.
CLOSED = r"[.!?؟。]+[\"”’»\\x27)\\]]*$"
REMAINS = r"(\\s*\\[(…|\\.{3}|\\+\\d+ chars)\\]|\\s*…|\\.{3}|&[#A-Za-z0-9]{0,7}|<[^<>]{0,200}|\\\\u?[0-9A-Fa-f]{0,4}|\\uFFFD+)+$"
#: A final trigram is no end of a text if less than this share of its uses end so.
SHARE = 0.01
#: Uses that the shorter n-gram's share counts for in a longer one's.
BACKOFF = 100
#: Uses for one end that are taken for granted of a kind of texts before any is counted.
UNSEEN = 20
#: A line whose first word begins last lines in at least this share of at least so many lines is a sign-off.
SIGN_OFF, SIGN_LINES = 0.8, 3

# A word, a number, a colon, a run of closing marks or of line ends.
TOKEN = r"[\p{L}\p{M}][\p{L}\p{M}\p{N}]*+|[0-9٠-٩]++(?:[.,][0-9٠-٩]++)*|\p{N}[\p{L}\p{M}\p{N}]*+|:|[.!?؟。]+|[\r\n]+"


def _code(t: str) -> str:
    """A token as a number: 0 for any number, 1 for a closing mark, 2 for a line's end, else the word's hash.

    Texts compare by their bytes, so that a range of first letters is two comparisons.
    """
    return f"""CASE WHEN {t} >= 'a' AND {t} < '{{' OR {t} >= '\u0621' AND {t} < '\u064b' THEN xxhash64({t}) WHEN {t} IS NULL OR {t} < ' ' THEN 2L
      WHEN {t} >= '0' AND {t} < ':' OR {t} >= '\u0660' AND {t} < '\u066a' THEN 0L
      WHEN {t} < '0' OR {t} >= '?' AND {t} < '@' OR {t} >= '\u061f' AND {t} < '\u0620' OR {t} >= '\u3002' AND {t} < '\u3003' THEN 1L ELSE xxhash64({t}) END"""


# kind: the heading of a text of one line, else empty; x, y: two words before z, 1 where a sentence or line begins
_GRAMS = rf"""
SELECT kind, x, y, z, count(*) AS n, count_if(after = 1) AS closed, count_if(after = 2 AND (inside OR kind <> xxhash64(''))) AS open
FROM (
  SELECT kind, IF(y IN (1, 2), 1L, IF(x IN (1, 2), 1L, x)) AS x, IF(y = 2, 1L, y) AS y, z, after, inside
  FROM (
    SELECT kind, {_code("t.x")} AS x, {_code("t.y")} AS y, {_code("t.z")} AS z, {_code("t.after")} AS after, t.after IS NOT NULL AS inside
    FROM (
      SELECT kind, inline(arrays_zip(concat(array('\n', '\n'), w), concat(array('\n'), w), w, slice(w, 2, size(w)))) AS (x, y, z, after)
      FROM (SELECT kind, regexp_extract_all(lower(left(text, length(text) - length(regexp_extract(right(text, 240), '{REMAINS}', 0)))), r'{TOKEN}', 0) AS w FROM kept)
    ) t WHERE t.z IS NOT NULL
  ) WHERE z NOT IN (1, 2)
) GROUP BY kind, x, y, z
"""
_KEPT = r"""WITH kept AS (
  SELECT *, xxhash64(IF(text RLIKE r'[\r\n]', '', lower(regexp_extract(text, r'^\s*(\p{L}+):\s', 1)))) AS kind
  FROM (SELECT doc_id, source, trim(TRAILING ' \t\r\n\u00a0\u200b\ufeff' FROM text) AS text FROM {documents}) WHERE trim(text) <> ''
)"""

_FIRST = "lower(substring_index(ltrim({line}), ' ', 1))"
_TAIL = "regexp_extract_all(lower({text}), r'{token}', 0)"
_JUDGED = rf"""
, lined AS (SELECT doc_id, source, kind, split(text, r'[\r\n]+\s*') AS lines FROM kept
), firsts AS (
  SELECT word FROM (
    SELECT {_FIRST.format(line="line")} AS word, pos = n - 1 AS last
    FROM (SELECT lines, size(lines) AS n FROM lined WHERE size(lines) > 1) LATERAL VIEW posexplode(lines) AS pos, line
  ) GROUP BY word HAVING count(*) >= {SIGN_LINES} AND count_if(last) >= {SIGN_OFF} * count(*)
), tails AS (
  SELECT doc_id, source, kind, size(lines) AS n, rtrim(element_at(lines, -1)) AS last, CASE WHEN size(lines) > 1 THEN rtrim(element_at(lines, -2)) END AS prior,
         {_FIRST.format(line="element_at(lines, -1)")} AS word
  FROM lined
), signs AS (
  SELECT t.*, n > 1 AND NOT last RLIKE '{CLOSED}' AND (
           NOT last RLIKE r'\p{{L}}' OR last RLIKE r'^\s*[(\[].*[)\]]$' OR last RLIKE r'https?://\S+$'
           OR (f.word IS NOT NULL AND last RLIKE r'\S\s+\S')) AS signed
  FROM tails t LEFT JOIN firsts f ON f.word = t.word
), bodies AS (
  SELECT doc_id, source, kind, signed, length(mark) > 0 AS remains, rtrim(left(whole, length(whole) - length(mark))) AS body
  FROM (SELECT *, IF(signed, prior, last) AS whole, regexp_extract(right(IF(signed, prior, last), 240), '{REMAINS}', 0) AS mark FROM signs)
), ends AS (
  SELECT doc_id, source, kind, signed, remains, IF(try_element_at(w, -1) RLIKE r'^[.!?؟。]', slice(w, 1, size(w) - 1), w) AS w, coalesce(try_element_at(w, -1) RLIKE r'^[.!?؟。]', false) AS closed
  FROM (
    SELECT *, IF(size(near) > 5 OR length(body) <= 300, near, {_TAIL.format(text="body", token=TOKEN)}) AS w
    FROM (SELECT *, {_TAIL.format(text="right(body, 300)", token=TOKEN)} AS near FROM bodies)
  )
), finals AS (
  SELECT doc_id, source, kind, signed, remains, closed, IF(y IN (1, 2), 1L, IF(x IN (1, 2), 1L, x)) AS x, IF(y = 2, 1L, y) AS y, z,
         -- whether the text's own end is among those that are counted for it
         IF(closed OR signed OR kind <> xxhash64(''), 1, 0) AS own
  FROM (SELECT *, {_code("try_element_at(w, -3)")} AS x, {_code("try_element_at(w, -2)")} AS y, {_code("try_element_at(w, -1)")} AS z FROM ends)
), two AS (SELECT kind, y, z, sum(n) AS n, sum(closed) AS closed, sum(open) AS open FROM {{grams}} GROUP BY kind, y, z
), one AS (SELECT kind, z, sum(n) AS n, sum(closed) AS closed, sum(open) AS open FROM {{grams}} GROUP BY kind, z
), any AS (SELECT kind, sum(n) AS n, sum(closed) AS closed, sum(open) AS open FROM one GROUP BY kind
), joined AS (
  SELECT f.*, coalesce(g.n, 0) AS n3, coalesce(IF(f.closed, g.closed, g.open), 0) AS e3, coalesce(t.n, 0) AS n2, coalesce(IF(f.closed, t.closed, t.open), 0) AS e2,
         coalesce(o.n, 0) AS n1, coalesce(IF(f.closed, o.closed, o.open), 0) AS e1, coalesce(a.n, 0) AS n0, coalesce(IF(f.closed, a.closed, a.open), 0) AS e0
  FROM finals f LEFT JOIN {{grams}} g ON g.kind = f.kind AND g.x = f.x AND g.y = f.y AND g.z = f.z
  LEFT JOIN two t ON t.kind = f.kind AND t.y = f.y AND t.z = f.z LEFT JOIN one o ON o.kind = f.kind AND o.z = f.z LEFT JOIN any a ON a.kind = f.kind
), shares AS (
  SELECT *, (greatest(e3 - own, 0) + {BACKOFF} * s2) / (greatest(n3 - 1, 0) + {BACKOFF}) AS s3
  FROM (SELECT *, (greatest(e2 - own, 0) + {BACKOFF} * s1) / (greatest(n2 - 1, 0) + {BACKOFF}) AS s2
  FROM (SELECT *, (greatest(e1 - own, 0) + {BACKOFF} * s0) / (greatest(n1 - 1, 0) + {BACKOFF}) AS s1
  FROM (SELECT *, (greatest(e0 - own, 0) + 1) / (greatest(n0 - 1, 0) + {UNSEEN}) AS s0 FROM joined)))
)
SELECT doc_id, source, signed, closed, remains, n3 AS uses, s3 AS end_share, s3 < {SHARE} AS cut FROM shares
"""


def _sql(text: str, **tables: DataFrame) -> DataFrame:
    """Runs SQL over tables, which are named in braces; its other braces are those of regular expressions."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = text.replace("{{%s}}" % name, "{%s}" % name)
    return next(iter(tables.values())).sparkSession.sql(text, **tables)


def verdicts(documents: DataFrame) -> DataFrame:
    """One row for each text that is not blank: doc_id, source, whether a sign-off follows, whether the text
    ends in a closing mark, whether a cut left something behind, how often its last trigram is used, the share
    of its uses that end as the text does, and whether it was cut.

    Null, empty and blank texts have no row. Repeated rows are judged each. Whole texts are counted. A text of
    one or two words is judged by these and its beginning; one without any word by its mark.
    """
    slim = documents.select("doc_id", "source", "text")
    return _sql(_KEPT + _JUDGED, documents=slim, grams=staged(_sql(_KEPT + _GRAMS, documents=slim)))


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id of each cut text."""
    return verdicts(documents).filter("cut").select("doc_id")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """For each source (null is one): texts, cut texts and their rate."""
    return documents.sparkSession.sql("SELECT source, count(*) AS n_texts, count_if(cut) AS n_cut, count_if(cut) / count(*) AS cut_rate FROM {judged} GROUP BY source", judged=verdicts(documents))
