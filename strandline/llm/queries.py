"""The registered queries of problems 1 to 8, each over its whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import lookalike, mixing, overlap, packing, splits, tokens, truncation, versions
from strandline.llm.common import table


def p1_assignment(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(table(spark, d, "domain_corpus_sample"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_assignment(spark, d).filter("torn").select("record_id")


def p1_balance(spark: SparkSession, d: str) -> DataFrame:
    """Rows and torn groups of the assignment, and whether each split is as near its quota as its largest group allows."""
    rows = p1_assignment(spark, d)
    groups = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("assigned_split").alias("splits"), F.min("assigned_split").alias("split"))
    total = groups.agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.count_if(F.col("splits") > 1).alias("torn"))
    shares = spark.createDataFrame(list(splits.SHARES.items()), "split string, share double")
    held = shares.join(groups.groupBy("split").agg(F.sum("n").alias("n")), "split", "left").crossJoin(F.broadcast(total))
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.col("total")) <= F.col("largest")
    return held.select("split", F.col("total").alias("n_rows"), F.col("torn").alias("n_torn_groups"), near.alias("near_quota"))


def p2_plain(spark: SparkSession, d: str) -> DataFrame:
    fields = lookalike.text_fields(table(spark, d, "example_ranking"), table(spark, d, "extraction_examples"))
    scores = lookalike.letter_scores(lookalike.all_values(fields, table(spark, d, "entities")))
    return lookalike.plain_fields(fields, scores)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_plain(spark, d).filter("changed").select("record_key", "field").distinct()


def p3_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_table(table(spark, d, "domain_corpus_sample"), table(spark, d, "corpus_sources"))


def p3_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_cube(table(spark, d, "domain_corpus_sample"), table(spark, d, "corpus_sources"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, d, "domain_corpus_sample"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "domain_corpus_sample"))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "example_ranking").select("article.article_id", "article.title", "article.body")
    return a.select("article_id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))).alias("content"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return versions.version_pairs(_articles(spark, d), "article_id", "content")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return versions.version_groups(_articles(spark, d), "article_id", "content")


def p6_contents(spark: SparkSession, d: str) -> DataFrame:
    return packing.contents(table(spark, d, "documents"), table(spark, d, "pack_profiles"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_contents(spark, d), table(spark, d, "pack_profiles"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each profile: texts placed, containers that hold too much, texts divided though they fit, texts with
    tokens that are missing or twice."""
    placed = p6_contents(spark, d)
    space = table(spark, d, "pack_profiles").select("profile_id", "capacity_tokens")
    texts = placed.groupBy("profile_id", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("token_start") + F.col("tokens")).alias("end")).join(space, "profile_id")
    per = texts.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("n_divided"), F.count_if(F.col("tokens") != F.col("end")).alias("n_incomplete"))
    boxes = placed.join(space, "profile_id").groupBy("profile_id", "container_id").agg(F.sum("tokens").alias("t"), F.max("used_tokens").alias("used"), F.first("capacity_tokens").alias("capacity"))
    over = boxes.groupBy("profile_id").agg(F.count_if((F.col("used") > F.col("capacity")) | (F.col("t") > F.col("used"))).alias("n_overfull"))
    return per.join(over, "profile_id")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each mix and source that has texts: whether no text is used too often and the share is within a
    twentieth, or two texts, of its target among the sources that have some."""
    got = p7_shares(spark, d)
    usable = got.filter("available > 0").groupBy("mix_id").agg(F.sum("target_share").alias("all_shares"), F.sum("tokens").alias("all_tokens"))
    longest = F.greatest(F.lit(1), F.col("available"))
    both = got.filter("available > 0").join(usable, "mix_id")
    off = F.abs(F.col("reached_share") - F.col("target_share") / F.col("all_shares"))
    return both.select("mix_id", "source", (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"), ((off <= 0.05) | (off * F.col("all_tokens") <= 2 * longest)).alias("share_kept"))


def p7_chosen(spark: SparkSession, d: str) -> DataFrame:
    taken, _ = mixing.chosen(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.drawn(taken).select("mix_id", "source", "doc_id", "tokens", "uses")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    taken, plan = mixing.chosen(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.shares(mixing.drawn(taken), plan)


def p7_shards(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shards(*mixing.chosen(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_assignment, p1_balance, p2_found, p2_plain, p3_tokens, p3_budget, p4_found, p4_report, p5_found, p5_groups, p6_contents, p6_fill, p6_checks, p7_chosen, p7_shares, p7_shards, p7_checks, p8_found, p8_rates)}

_WORDS = r"""list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}][\p{{L}}\p{{M}}\p{{N}}]*|[0-9\x{{0660}}-\x{{0669}}]+(?:[.,][0-9\x{{0660}}-\x{{0669}}]+)*|\p{{N}}[\p{{L}}\p{{M}}\p{{N}}]*|:|[.!?؟。]+|[\r\n]+'),
    lambda t: CASE WHEN regexp_matches(t, '^[0-9\x{{0660}}-\x{{0669}}]') THEN '0' WHEN regexp_matches(t, '^[\r\n]') THEN '¶' WHEN regexp_matches(t, '^[.!?؟。]') THEN '.' ELSE t END)"""
_REMAINS = r"(\s*\[(…|\.{3}|\+\d+ chars)\]|\s*…|\.{3}|&[#A-Za-z0-9]{0,7}|<[^<>]{0,200}|\\u?[0-9A-Fa-f]{0,4}|\x{FFFD}+)+$"
# two words before the last, ¶ where a sentence or line begins
_BEFORE = "CASE WHEN {y} IN ('¶', '.') OR {x} IN ('¶', '.') THEN '¶' ELSE {x} END AS x, CASE WHEN {y} = '.' THEN '¶' ELSE {y} END AS y"
_JUDGED = rf"""
WITH kept AS (
  SELECT doc_id, source, left(t, length(t) - length(regexp_extract(t, '{_REMAINS}'))) AS bare, t AS text
  FROM (SELECT doc_id, source, rtrim(text, ' ' || chr(9) || chr(13) || chr(10) || chr(160) || chr(8203) || chr(65279)) AS t FROM documents) WHERE trim(t) <> ''
), split_up AS (
  SELECT *, regexp_split_to_array(text, '[\r\n]+\s*') AS lines, CASE WHEN regexp_matches(text, '[\r\n]') THEN '' ELSE lower(regexp_extract(text, '^\s*(\p{{L}}+):\s', 1)) END AS kind FROM kept
), each_line AS (SELECT len(lines) AS n, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM split_up),
firsts AS (
  SELECT lower(split_part(ltrim(line), ' ', 1)) AS word FROM each_line WHERE n > 1 GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (pos = n) >= 0.8 * count(*)
), tails AS (
  SELECT doc_id, source, kind, len(lines) AS n, rtrim(lines[-1]) AS last, rtrim(lines[-2]) AS prior, lower(split_part(ltrim(lines[-1]), ' ', 1)) AS word FROM split_up
), signs AS (
  SELECT t.*, n > 1 AND NOT regexp_matches(last, '[.!?؟。]+["”’»\x27)\]]*$') AND (
    NOT regexp_matches(last, '\p{{L}}') OR regexp_matches(last, '^\s*[(\[].*[)\]]$') OR regexp_matches(last, 'https?://\S+$')
    OR (f.word IS NOT NULL AND regexp_matches(last, '\S\s+\S'))) AS signed
  FROM tails t LEFT JOIN firsts f ON f.word = t.word
), bodies AS (SELECT *, CASE WHEN signed THEN prior ELSE last END AS whole FROM signs),
ends AS (SELECT *, {_WORDS.format(f"rtrim(regexp_replace(whole, '{_REMAINS}', ''))")} AS w FROM bodies),
trimmed AS (SELECT * REPLACE (CASE WHEN w[-1] = '.' THEN w[:-2] ELSE w END AS w), coalesce(w[-1] = '.', false) AS closed FROM ends),
finals AS (
  SELECT *, {_BEFORE.format(x="coalesce(w[-3], '¶')", y="coalesce(w[-2], '¶')")}, w[-1] AS z, CASE WHEN closed OR signed OR kind <> '' THEN 1 ELSE 0 END AS own FROM trimmed
), read AS (SELECT kind, list_concat(['¶', '¶'], {_WORDS.format("bare")}) AS w FROM split_up),
places AS (SELECT kind, w, unnest(range(3, len(w) + 1)) AS i FROM read),
grams AS (
  SELECT kind, x, y, z, count(*) AS n, count(*) FILTER (s = '.') AS closed, count(*) FILTER (s = '¶' OR (s IS NULL AND kind <> '')) AS open
  FROM (SELECT kind, {_BEFORE.format(x="w[i - 2]", y="w[i - 1]")}, w[i] AS z, w[i + 1] AS s FROM places WHERE w[i] NOT IN ('¶', '.')) GROUP BY ALL
), two AS (SELECT kind, y, z, sum(n) AS n, sum(closed) AS closed, sum(open) AS open FROM grams GROUP BY ALL),
one AS (SELECT kind, z, sum(n) AS n, sum(closed) AS closed, sum(open) AS open FROM grams GROUP BY ALL),
al AS (SELECT kind, sum(n) AS n, sum(closed) AS closed, sum(open) AS open FROM one GROUP BY ALL),
joined AS (
  SELECT f.doc_id, f.source, f.own, coalesce(g.n, 0) AS n3, coalesce(CASE WHEN f.closed THEN g.closed ELSE g.open END, 0) AS e3, coalesce(t.n, 0) AS n2, coalesce(CASE WHEN f.closed THEN t.closed ELSE t.open END, 0) AS e2,
    coalesce(o.n, 0) AS n1, coalesce(CASE WHEN f.closed THEN o.closed ELSE o.open END, 0) AS e1, coalesce(a.n, 0) AS n0, coalesce(CASE WHEN f.closed THEN a.closed ELSE a.open END, 0) AS e0
  FROM finals f LEFT JOIN grams g ON g.kind = f.kind AND g.x = f.x AND g.y = f.y AND g.z = f.z
  LEFT JOIN two t ON t.kind = f.kind AND t.y = f.y AND t.z = f.z LEFT JOIN one o ON o.kind = f.kind AND o.z = f.z LEFT JOIN al a ON a.kind = f.kind
), s0 AS (SELECT *, (greatest(e0 - own, 0) + 1) / (greatest(n0 - 1, 0) + 20) AS s0 FROM joined),
s1 AS (SELECT *, (greatest(e1 - own, 0) + 100 * s0) / (greatest(n1 - 1, 0) + 100) AS s1 FROM s0),
s2 AS (SELECT *, (greatest(e2 - own, 0) + 100 * s1) / (greatest(n2 - 1, 0) + 100) AS s2 FROM s1),
judged AS (SELECT doc_id, source, (greatest(e3 - own, 0) + 100 * s2) / (greatest(n3 - 1, 0) + 100) < 0.01 AS cut FROM s2)
"""

ORACLES = {
    "p1_found": """
WITH RECURSIVE r AS (
  SELECT record_id, nullif(lower(trim(source_id)), '') AS s, CASE WHEN trim(document_id) <> '' THEN document_id END AS d,
         CASE WHEN lower(trim(split)) IN ('val', 'dev', 'valid', 'validation') THEN 'validation' ELSE nullif(lower(trim(split)), '') END AS sp
  FROM domain_corpus_sample
), e AS (SELECT DISTINCT a.s AS x, b.s AS y FROM r a JOIN r b ON a.d = b.d WHERE a.s IS NOT NULL AND b.s IS NOT NULL),
reach AS (SELECT s AS x, s AS y FROM r WHERE s IS NOT NULL UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
root AS (SELECT x, min(y) AS g FROM reach GROUP BY x),
doc AS (SELECT d, min(s) AS s FROM r WHERE d IS NOT NULL GROUP BY d),
named AS (
  SELECT r.record_id, r.sp, CASE WHEN root.g IS NOT NULL THEN 's:' || root.g WHEN r.d IS NOT NULL THEN 'd:' || r.d ELSE 'r:' || r.record_id END AS g
  FROM r LEFT JOIN doc ON doc.d = r.d LEFT JOIN root ON root.x = coalesce(doc.s, r.s)
), votes AS (SELECT g, sp, count(*) AS n FROM named WHERE sp IS NOT NULL GROUP BY g, sp),
most AS (SELECT g, sp FROM votes QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, CASE sp WHEN 'train' THEN 0 WHEN 'validation' THEN 1 WHEN 'test' THEN 2 ELSE 99 END, sp DESC) = 1)
SELECT record_id FROM named JOIN most USING (g) WHERE named.sp IS NOT NULL AND named.sp <> most.sp""",
    "p1_balance": "SELECT split, (SELECT count(*) FROM domain_corpus_sample) AS n_rows, 0::BIGINT AS n_torn_groups, true AS near_quota FROM (VALUES ('train'), ('validation'), ('test')) AS s(split)",
    "p6_checks": "SELECT profile_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS n_texts, 0::BIGINT AS n_divided, 0::BIGINT AS n_incomplete, 0::BIGINT AS n_overfull FROM pack_profiles",
    "p7_checks": "SELECT mix_id, source, true AS repeats_kept, true AS share_kept FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE text <> '')",
    "p8_found": _JUDGED + "SELECT doc_id FROM judged WHERE cut",
    "p8_rates": _JUDGED + "SELECT source, count(*) AS n_texts, count(*) FILTER (cut) AS n_cut, count(*) FILTER (cut) / count(*) AS cut_rate FROM judged GROUP BY 1",
}
