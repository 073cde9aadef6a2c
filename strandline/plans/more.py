"""Further registered queries of the core: explanations, links, checks, keyed indexes, audits and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import records
from strandline.functions import text as T
from strandline.operators import index, linking, metrics, ranking, sampling, semantic, tables, validate
from strandline.plans.catalog import _ALIAS, _COVER, _EX, _FP, _LINKS, _MENTIONS, _TAGS, _TFIDF, _WK, KINDS, _examples, _query, _similarities, _t, _tags, _want
from strandline.plans.staging import shared_dir, staged
from strandline.sources import readers
from strandline.streaming import streams

# SQL: the different runs of three characters of a name, a blank before and after it
_RUNS = "list_distinct(list_transform(range(1, greatest(length({0}), 1) + 1), lambda i: substr(' ' || {0} || ' ', i, 3)))"


def _vec(source: str, value: str, name: str) -> str:
    return f"{name} AS (SELECT v, unnest(r) AS f, 1 / sqrt(len(r)) AS w FROM (SELECT v, {_RUNS.format('v')} AS r FROM (SELECT DISTINCT {value} AS v FROM {source})))"


def _wants(spark: SparkSession, d: str) -> DataFrame:
    return ranking.long_tags(_t(spark, d, "users"), "user_id", F.col("interests")).select("user_id", "category", "norm").distinct()


def _tag_rows(spark: SparkSession, d: str) -> DataFrame:
    return ranking.long_tags(_examples(spark, d), "example_id", _tags()).select("example_id", "category", "norm").distinct()


# explanations

_RELATED = (
    f"WITH {_EX}, {_TAGS}, {_want('interests')}, {_vec('want', 'norm', 'va')}, {_vec('tags', 'norm', 'vb')},"
    " alike AS (SELECT va.v AS interest, vb.v AS tag, round(sum(va.w * vb.w), 5) AS similarity FROM va JOIN vb USING (f) GROUP BY 1, 2 HAVING round(sum(va.w * vb.w), 5) >= 0.45),"
    " exact AS (SELECT DISTINCT user_id, example_id, norm FROM want JOIN tags USING (category, norm)),"
    " w AS (SELECT DISTINCT user_id, norm AS interest FROM want), t AS (SELECT DISTINCT example_id, norm AS tag FROM tags),"
    " related AS (SELECT user_id, example_id, interest, tag, similarity, row_number() OVER (PARTITION BY user_id, example_id ORDER BY similarity DESC, interest, tag) AS rank FROM alike JOIN w USING (interest) JOIN t USING (tag)"
    " WHERE NOT EXISTS (FROM exact e WHERE e.user_id = w.user_id AND e.example_id = t.example_id AND e.norm IN (interest, tag)) QUALIFY rank <= 3)"
)


@_query(_RELATED + " SELECT * FROM related")
def related_tags(spark: SparkSession, d: str) -> DataFrame:
    """The three most similar different names of each user's interests and each record's tags."""
    return semantic.related_tags(_wants(spark, d), _tag_rows(spark, d), "user_id", "example_id")


_STOP = ", ".join(f"'{w}'" for w in semantic.STOP_WORDS)


def _phr(source: str, key: str, text: str) -> str:
    """SQL for the phrases of a text: key, phrase, first word, number of words."""
    words = f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+(?:[-''][\\p{{L}}\\p{{N}}]+)*')[:48]"
    return (
        f"(SELECT {key}, p, f, n FROM (SELECT {key}, array_to_string(r, ' ') AS p, i - 1 AS f, n, r FROM (SELECT {key}, w[i : i + n - 1] AS r, i, n FROM (SELECT {key}, {words} AS w, unnest(range(1, 49)) AS i FROM {source} WHERE {text} IS NOT NULL), (VALUES (1), (2)) AS l(n) WHERE i + n - 1 <= len(w)))"
        f" WHERE len(list_filter(r, lambda x: lower(x) NOT IN ({_STOP}) AND length(x) > 1)) > 0 AND (n = 1 OR (lower(r[1]) NOT IN ({_STOP}) AND lower(r[-1]) NOT IN ({_STOP})))"
        f" QUALIFY row_number() OVER (PARTITION BY {key}, lower(p) ORDER BY n, f) = 1)"
    )


@_query(f"SELECT doc_id, p AS phrase, f AS first, n FROM {_phr('documents', 'doc_id', 'title')}")
def title_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The phrases of each document's title."""
    p = _t(spark, d, "documents").select("doc_id", F.explode(semantic.phrases("title")).alias("p"))
    return p.select("doc_id", "p.phrase", "p.first", "p.n")


_PAIRS = (
    f"WITH {_EX}, a AS (SELECT user_id, lower(p) AS v, p AS pa, f AS fa, n AS na FROM {_phr('users', 'user_id', 'query')}), b AS (SELECT example_id, lower(p) AS v, p AS pb, f AS fb, n AS nb FROM {_phr('ex', 'example_id', 'text')}),"
    f" {_vec('a', 'v', 'va')}, {_vec('b', 'v', 'vb')}, alike AS (SELECT va.v AS x, vb.v AS y, round(sum(va.w * vb.w), 5) AS similarity FROM va JOIN vb USING (f) GROUP BY 1, 2 HAVING round(sum(va.w * vb.w), 5) >= 0.55),"
    " met AS (SELECT user_id, example_id, pa, fa, na, pb, fb, nb, similarity, row_number() OVER (PARTITION BY user_id, example_id ORDER BY round(similarity + 0.002 * (na + nb - 2), 5) DESC, na, fa, nb, fb) AS o FROM alike JOIN a ON a.v = x JOIN b ON b.v = y)"
)
_APART = "(({0}.fa + {0}.na <= {1}.fa OR {1}.fa + {1}.na <= {0}.fa) AND ({0}.fb + {0}.nb <= {1}.fb OR {1}.fb + {1}.nb <= {0}.fb))"


@_query(
    _PAIRS + ", one AS (SELECT * FROM met WHERE o = 1)"
    f", two AS (SELECT m.* FROM met m JOIN one USING (user_id, example_id) WHERE {_APART.format('m', 'one')} QUALIFY row_number() OVER (PARTITION BY m.user_id, m.example_id ORDER BY m.o) = 1)"
    f", three AS (SELECT m.* FROM met m JOIN one USING (user_id, example_id) JOIN two USING (user_id, example_id) WHERE {_APART.format('m', 'one')} AND {_APART.format('m', 'two')} QUALIFY row_number() OVER (PARTITION BY m.user_id, m.example_id ORDER BY m.o) = 1)"
    " SELECT user_id, example_id, pa AS query_phrase, pb AS phrase, similarity, rank FROM (SELECT *, 1 AS rank FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three)"
)
def related_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Up to three pairs of phrases that connect each user's written interest with each record's text."""
    return semantic.related_phrases(_t(spark, d, "users"), _examples(spark, d), "user_id", "query", "example_id", "text")


_WHOLE = (
    f"cov AS (SELECT user_id, example_id, coverage FROM (WITH {_want('CASE WHEN coalesce(len(flatten(map_values(required_filters))), 0) > 0 THEN required_filters ELSE interests END')}, {_COVER} SELECT * FROM cover)),"
    f" dir AS (SELECT user_id, example_id, direct FROM (WITH {_want('required_filters')}, {_COVER} SELECT * FROM cover)),"
    " whole AS (SELECT user_id, example_id, greatest(0, least(100, round_even(round(coalesce(similarity, 0), 5) * 100, 0)))::INT AS embedding_score, round_even(coalesce(coverage, 0) * 100, 0)::INT AS metadata_score, coalesce(direct, false) AS direct"
    " FROM sims FULL JOIN cov USING (user_id, example_id) LEFT JOIN dir USING (user_id, example_id)),"
    " scored AS (SELECT *, round_even(0.75 * embedding_score + 0.25 * metadata_score, 0)::INT AS score FROM whole)"
)


def _whole_scores(spark: SparkSession, d: str) -> DataFrame:
    some = F.coalesce(F.size(F.flatten(F.map_values("required_filters"))) > 0, F.lit(False))
    users, tags = _t(spark, d, "users"), ranking.long_tags(_examples(spark, d), "example_id", _tags())
    wanted = users.select("user_id", F.when(some, F.col("required_filters")).otherwise(F.col("interests")).alias("wanted"))
    cover = ranking.filter_coverage(ranking.long_tags(wanted, "user_id", F.col("wanted")), tags, "user_id", "example_id").select("user_id", "example_id", "coverage")
    direct = ranking.filter_coverage(ranking.long_tags(users, "user_id", F.col("required_filters")), tags, "user_id", "example_id").select("user_id", "example_id", "direct")
    both = _similarities(spark, d).withColumn("similarity", F.round("similarity", 5)).join(cover, ["user_id", "example_id"], "full").join(direct, ["user_id", "example_id"], "left")
    sim, cov = F.coalesce("similarity", F.lit(0.0)), F.coalesce("coverage", F.lit(0.0))
    return both.select("user_id", "example_id", semantic.percent(sim).alias("embedding_score"), F.bround(cov * 100, 0).cast("int").alias("metadata_score"), F.coalesce("direct", F.lit(False)).alias("direct"), semantic.whole_score(sim, cov).alias("score"))


@_query(f"WITH {_EX}, {_TAGS}, {_TFIDF}, {_WHOLE} SELECT user_id, example_id, embedding_score, metadata_score, direct, score, row_number() OVER (PARTITION BY user_id ORDER BY direct DESC, score DESC, created_at DESC, example_id) AS rank FROM scored JOIN ex USING (example_id) QUALIFY rank <= 10")
def whole_rank(spark: SparkSession, d: str) -> DataFrame:
    """The ten best records of each user by whole scores, newer ones first at ties."""
    dated = _whole_scores(spark, d).join(_examples(spark, d).select("example_id", "created_at"), "example_id")
    return semantic.stable_rank(dated, "user_id", [F.desc("direct"), F.desc("score"), F.desc("created_at")], "example_id", 10).drop("created_at")


@_query(f"WITH {_EX}, {_TAGS}, {_TFIDF}, {_WHOLE} SELECT user_id, count(*) AS n, max(score) AS best FROM scored WHERE score >= 20 GROUP BY 1")
def scores_above(spark: SparkSession, d: str) -> DataFrame:
    """How many records reach a whole score of 20 for each user."""
    return semantic.scored_above(_whole_scores(spark, d), "score", 20).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@_query(
    _RELATED + f", {_TFIDF}, named AS (SELECT user_id, example_id, string_agg(norm, '|' ORDER BY norm) AS e FROM (SELECT DISTINCT user_id, example_id, norm FROM want JOIN tags USING (category, norm) QUALIFY row_number() OVER (PARTITION BY user_id, example_id ORDER BY norm) <= 3) GROUP BY 1, 2),"
    " rel AS (SELECT user_id, example_id, string_agg(tag, '|' ORDER BY rank) AS r FROM related WHERE rank <= 2 GROUP BY 1, 2)"
    " SELECT user_id, example_id, concat_ws('|', e, greatest(0, least(100, round_even(round(coalesce(similarity, 0), 5) * 100, 0)))::INT::VARCHAR || '%', r) AS reasons FROM named LEFT JOIN rel USING (user_id, example_id) LEFT JOIN sims USING (user_id, example_id)"
)
def match_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a record that shares a name with a user's interests is shown: names, similarity, related names."""
    wants, tags = _wants(spark, d), _tag_rows(spark, d)
    exact = tags.join(wants, ["category", "norm"]).groupBy("user_id", "example_id").agg(F.array_sort(F.collect_set("norm")).alias("e"))
    related = semantic.related_tags(wants, tags, "user_id", "example_id").groupBy("user_id", "example_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("r"))
    both = exact.join(related, ["user_id", "example_id"], "left").join(_similarities(spark, d), ["user_id", "example_id"], "left")
    shown = F.concat(semantic.percent(F.round(F.coalesce("similarity", F.lit(0.0)), 5)).cast("string"), F.lit("%"))
    return both.select("user_id", "example_id", F.array_join(semantic.reasons(F.col("e"), shown, F.coalesce("r", F.array().cast("array<string>"))), "|").alias("reasons"))


# links


def _training_links(spark: SparkSession, d: str) -> DataFrame:
    """Labelled names with the one entity that bears their name, and the text around them."""
    ex = _examples(spark, d)
    at = linking.mentions(ex, "example_id", "text").filter("start is not null").join(ex.select("example_id", "text", "language", "split"), "example_id")
    named = at.withColumns({"surface": F.col("mention"), "context": T.around("text", F.col("start"), F.col("end"))})
    targets = linking.alias_targets(named, _t(spark, d, "entities"), "surface").filter("entity_id is not null").select("surface", "entity_id")
    key = F.concat_ws("\x1f", "example_id", F.lpad(F.col("start").cast("string"), 9, "0"), "category", "surface")
    return named.join(targets, "surface").select("example_id", "split", "language", "surface", "context", "entity_id", key.alias("seq"))


_LINK = (
    f"{_EX}, {_MENTIONS}, {_ALIAS}, uniq AS (SELECT alias_key, min(entity_id) AS entity_id FROM alias GROUP BY 1 HAVING count(DISTINCT entity_id) = 1),"
    f" links AS (SELECT m.example_id, ex.split, ex.language, mention AS surface, substr(m.text, CAST(greatest(0, instr(m.text, mention) - 1 - 180) + 1 AS BIGINT), CAST(instr(m.text, mention) - 1 + length(mention) + 180 - greatest(0, instr(m.text, mention) - 1 - 180) AS BIGINT)) AS context,"
    f" entity_id, concat_ws(chr(31), m.example_id, lpad((instr(m.text, mention) - 1)::VARCHAR, 9, '0'), category, mention) AS seq FROM m JOIN ex USING (example_id) JOIN uniq ON uniq.alias_key = {_WK.format('mention')} WHERE instr(m.text, mention) > 0)"
)
_TRAINED = (
    "cnt AS (SELECT entity_id, surface, sum(CASE WHEN language = 'en' THEN 3 ELSE 1 END) AS w, count(*) AS n, min(seq) AS seen FROM links WHERE split = 'train' GROUP BY 1, 2),"
    f" nam AS (SELECT entity_id, arg_min(surface, (-w, seen)) AS name, sum(n)::BIGINT AS n_links, list_sort(list_distinct(list({_WK.format('surface')}))) AS alias_keys FROM cnt GROUP BY 1),"
    " ctx AS (SELECT entity_id, coalesce(arg_max(context, seq) FILTER (language = 'en'), arg_min(context, seq)) AS context FROM links WHERE split = 'train' GROUP BY 1)"
)


@_query(f"WITH {_LINK}, {_TRAINED} SELECT entity_id, name, n_links, array_to_string(alias_keys, '|') AS aliases, context FROM nam JOIN ctx USING (entity_id) QUALIFY row_number() OVER (ORDER BY n_links DESC, entity_id) <= 3000")
def trained_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Entities as the training split names and describes them."""
    got = linking.trained_catalogue(_training_links(spark, d).filter("split = 'train'"), "seq")
    return got.select("entity_id", "name", "n_links", F.array_join("alias_keys", "|").alias("aliases"), "context")


@_query(f"WITH {_LINK}, c AS (SELECT surface, entity_id, count(*) AS n, min(seq) AS seen FROM links GROUP BY 1, 2) SELECT surface, arg_min(entity_id, (-n, seen, entity_id)) AS entity_id, max(n) AS n FROM c GROUP BY 1")
def commonest_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entity that each labelled name most often stands for."""
    return linking.commonest(_training_links(spark, d), "surface", "entity_id", "seq")


# Fixed values of the demonstration: what a trained model would hold.
_FEATURES, _MEAN, _SCALE, _COEF, _BIAS, _ACCEPT = ["mention_score", "context_score", "lexical", "product"], [0.4, 0.15, 0.4, 0.06], [0.35, 0.1, 0.35, 0.1], [1.6, 0.5, 1.2, 0.4], -1.0, 0.8


def _held_out_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    links = staged(_training_links(spark, d))
    catalogue = staged(linking.trained_catalogue(links.filter("split = 'train'"), "seq"))
    asked = links.filter("split <> 'train'").select(F.col("seq").alias("mention_id"), "surface", "context", "language", F.col("entity_id").alias("gold"))
    scored = linking.link_features(asked, catalogue).withColumn("link_score", F.round(linking.link_score(_FEATURES, _MEAN, _SCALE, _COEF, _BIAS), 6))
    return asked, catalogue, scored


def _sql_runs(source: str, value: str, name: str) -> str:
    return f"{name} AS (SELECT v, len(r) AS n, unnest(r) AS f FROM (SELECT v, {_RUNS.format('v')} AS r FROM (SELECT DISTINCT {value} AS v FROM {source})))"


_WORDS2 = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{2,}}'))"
_FEATURED = (
    f"{_TRAINED}, cat AS (SELECT *, {_WK.format('name')} AS cat_key FROM nam JOIN ctx USING (entity_id)), asked AS (SELECT seq AS mention_id, surface, context, language, entity_id AS gold, {_WK.format('surface')} AS name_key FROM links WHERE split <> 'train'),"
    f" {_sql_runs('asked', 'name_key', 'ra')}, {_sql_runs('cat', 'cat_key', 'rb')}, sh AS (SELECT ra.v AS name_key, rb.v AS cat_key, count(*) AS s, any_value(ra.n) AS na, any_value(rb.n) AS nb FROM ra JOIN rb USING (f) GROUP BY 1, 2),"
    " prs AS (SELECT mention_id, entity_id, alias_keys, name_key, round(s / sqrt(na * nb), 5) AS mention_score, round(s / (na + nb - s), 5) AS common FROM asked JOIN sh USING (name_key) JOIN cat USING (cat_key)),"
    f" sd AS (SELECT mention_id, unnest(w) AS f, 1 / sqrt(len(w)) AS x FROM (SELECT mention_id, {_WORDS2.format('context')} AS w FROM asked)), tl AS (SELECT entity_id, unnest(w) AS f, 1 / sqrt(len(w)) AS x FROM (SELECT entity_id, {_WORDS2.format('context')} AS w FROM cat)),"
    " nr AS (SELECT mention_id, entity_id, round(sum(sd.x * tl.x), 5) AS context_score FROM sd JOIN tl USING (f) GROUP BY 1, 2),"
    " fe AS (SELECT mention_id, entity_id, mention_score, coalesce(context_score, 0) AS context_score, CASE WHEN list_contains(alias_keys, name_key) THEN 1.0 ELSE common END AS lexical FROM prs LEFT JOIN nr USING (mention_id, entity_id)),"
    " ft AS (SELECT mention_id, entity_id, mention_score, context_score, lexical, round(mention_score * context_score, 5) AS product, row_number() OVER (PARTITION BY mention_id ORDER BY round(mention_score + context_score + lexical, 5) DESC, entity_id) AS place FROM fe QUALIFY place <= 10),"
    " sc AS (SELECT *, round(1 / (1 + exp(-greatest(-50, least(50, " + f"{_BIAS} + " + " + ".join(f"({f} - {m}) / {s} * {c}" for f, m, s, c in zip(_FEATURES, _MEAN, _SCALE, _COEF)) + ")))), 6) AS link_score FROM ft)"
)


@_query(f"WITH {_LINK}, {_FEATURED} SELECT mention_id, entity_id, mention_score, context_score, lexical, place FROM ft")
def link_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest trained entities of each name in validation and test, with their features."""
    return _held_out_links(spark, d)[2].select("mention_id", "entity_id", *_FEATURES[:3], "place")


_LINKED_TO = f"ln AS (SELECT mention_id, CASE WHEN max(link_score) >= {_ACCEPT} THEN arg_min(entity_id, (-link_score, entity_id)) END AS accepted, list(entity_id) AS cands FROM sc GROUP BY 1)"


@_query(f"WITH {_LINK}, {_FEATURED} SELECT mention_id, CASE WHEN max(link_score) >= {_ACCEPT} THEN arg_min(entity_id, (-link_score, entity_id)) END AS entity_id, round(max(link_score), 4) AS score, CASE WHEN max(link_score) >= {_ACCEPT} THEN 'linked' ELSE 'unresolved' END AS status, array_to_string(list(entity_id ORDER BY link_score DESC, entity_id)[:3], '|') AS candidates FROM sc GROUP BY 1")
def linked_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in validation and test linked to trained entities by a given model, or left unresolved."""
    got = linking.linked(_held_out_links(spark, d)[2], "link_score", _ACCEPT)
    return got.select("mention_id", "entity_id", F.round("score", 4).alias("score"), "status", F.array_join("candidates", "|").alias("candidates"))


def _link_measures(ratio: str) -> str:
    subsets = {"accepted_precision": ("accepted IS NOT NULL", "accepted = gold"), "accepted_coverage": ("true", "accepted IS NOT NULL"), "correct_link_accuracy": ("true", "accepted = gold"), "unique_alias_accuracy": ("true", "alias_entity = gold"), "catalogue_coverage": ("true", "known"), "candidate_recall_known": ("known", "retrieved"), "unknown_abstention": ("NOT known", "accepted IS NULL"), "unseen_alias_accuracy": ("known AND n_aliased = 0", "accepted = gold"), "ambiguous_alias_accuracy": ("known AND n_aliased > 1", "accepted = gold")}
    return ", ".join(f"CASE WHEN count(*) FILTER ({of}) > 0 THEN round(count(*) FILTER (({of}) AND ({hit})) / count(*) FILTER ({of}), 6) ELSE {ratio} END AS {k}" for k, (of, hit) in subsets.items())


_JUDGED_LINKS = (
    f"WITH {_LINK}, {_FEATURED}, {_LINKED_TO}, al AS (SELECT k, count(*) AS n_aliased, min(entity_id) AS only_id FROM (SELECT entity_id, unnest(alias_keys) AS k FROM cat) GROUP BY 1),"
    " jl AS (SELECT a.language, a.gold, ln.accepted, CASE WHEN al.n_aliased = 1 THEN al.only_id END AS alias_entity, coalesce(al.n_aliased, 0) AS n_aliased, cat.entity_id IS NOT NULL AS known, coalesce(list_contains(ln.cands, a.gold), false) AS retrieved"
    " FROM asked a LEFT JOIN ln USING (mention_id) LEFT JOIN al ON al.k = a.name_key LEFT JOIN cat ON cat.entity_id = a.gold)"
)


def _judged_links(spark: SparkSession, d: str) -> DataFrame:
    asked, catalogue, scored = _held_out_links(spark, d)
    got = linking.linked(scored, "link_score", _ACCEPT, 10).select("mention_id", F.col("entity_id").alias("accepted"), "candidates")
    borne = catalogue.select("entity_id", F.explode("alias_keys").alias("name_key")).groupBy("name_key").agg(F.count(F.lit(1)).alias("n_aliased"), F.min("entity_id").alias("only"))
    both = asked.withColumn("name_key", T.word_key("surface")).join(got, "mention_id", "left").join(borne, "name_key", "left").join(catalogue.select(F.col("entity_id").alias("gold"), F.lit(True).alias("known")), "gold", "left")
    return both.select("language", "gold", "accepted", F.when(F.col("n_aliased") == 1, F.col("only")).alias("alias_entity"), F.coalesce("n_aliased", F.lit(0)).alias("n_aliased"), F.coalesce("known", F.lit(False)).alias("known"), F.coalesce(F.array_contains("candidates", F.col("gold")), F.lit(False)).alias("retrieved"))


@_query(_JUDGED_LINKS + f" SELECT coalesce(language, 'all') AS language, count(*) AS mentions, count(accepted) AS n_accepted, {_link_measures('NULL')} FROM jl GROUP BY ROLLUP (language)")
def link_quality(spark: SparkSession, d: str) -> DataFrame:
    """Measures of the links of validation and test by language and over all; ratios of nothing are null."""
    return metrics.link_scores_of(_judged_links(spark, d), ["language"])


@_query(_JUDGED_LINKS + f" SELECT coalesce(language, 'all') AS language, count(*) AS mentions, count(accepted) AS n_accepted, {_link_measures('0')} FROM jl GROUP BY ROLLUP (language)")
def link_quality_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same measures with ratios of nothing as 0."""
    return metrics.link_scores_of(_judged_links(spark, d), ["language"], null_empty=False)


# checks


@_query(
    "WITH r AS (SELECT result_id, coalesce(CASE WHEN trim(article.article_id) <> '' THEN article.article_id END, substr(sha256(coalesce(article.title, '') || chr(10) || coalesce(article.body, '')), 1, 20)) AS article_id,"
    " coalesce(length(trim(article.body)) BETWEEN 20 AND 15000, false) AS b, coalesce(length(trim(article.title)), 0) <= 500 AS t FROM example_ranking)"
    " SELECT result_id, article_id, concat_ws('|', CASE WHEN NOT b THEN 'body is not of 20 to 15000 characters' END, CASE WHEN NOT t THEN 'title is longer than 500 characters' END) AS errors FROM r"
)
def article_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each ranked article's id and errors as an input."""
    return _t(spark, d, "example_ranking").select("result_id", validate.article_key().alias("article_id"), F.array_join(validate.article_errors(), "|").alias("errors"))


@_query(
    "SELECT s.source_id, concat_ws('|', CASE WHEN coalesce(trim(s.source_id), '') = '' THEN 'source_id is empty' END, CASE WHEN n > 1 THEN 'source_id is there twice' END, CASE WHEN NOT coalesce(rights_status IN ('approved', 'unknown', 'requires_authorization', 'denied'), false) THEN 'rights are of no known name' END,"
    " CASE WHEN NOT coalesce(regexp_matches(homepage, '^https?://[^/\\s:?#]+'), false) THEN 'homepage is no address' END, CASE WHEN coalesce(list_contains(allowed_uses, 'model_training'), false) AND rights_status = 'approved' AND coalesce(trim(license_id), '') = '' THEN 'training without a licence' END) AS errors"
    " FROM corpus_sources s JOIN (SELECT source_id, count(*) AS n FROM corpus_sources GROUP BY 1) c ON c.source_id IS NOT DISTINCT FROM s.source_id"
)
def manifest_checks(spark: SparkSession, d: str) -> DataFrame:
    """Errors of each row of the source manifest."""
    return validate.manifest_errors(_t(spark, d, "corpus_sources")).select("source_id", F.array_join("errors", "|").alias("errors"))


_KEYS = sorted(validate.SCHEMAS[2])


@_query(
    f"WITH {_EX} SELECT example_id, concat_ws('|', CASE WHEN " + " OR ".join(f"labels.{k} IS NULL" for k in _KEYS) + " THEN 'keys are not those of the schema' END, "
    + ", ".join(f"CASE WHEN labels.{k} IS NULL OR len(list_filter(labels.{k}, lambda v: v IS NULL OR trim(v) = '')) > 0 THEN '{k} is no list of names' END" for k in validate.SCHEMAS[2][:-1])
    + ", CASE WHEN labels.relationships IS NULL OR len(list_filter(labels.relationships, lambda r: coalesce(trim(r.subject), '') = '' OR coalesce(trim(r.relation), '') = '' OR coalesce(trim(r.object), '') = '')) > 0 THEN 'relationships are malformed' END) AS errors FROM ex"
)
def response_checks(spark: SparkSession, d: str) -> DataFrame:
    """Errors of each example's labels, read as an extraction's JSON text."""
    ex = _examples(spark, d).select("example_id", F.to_json("labels").alias("raw"))
    return ex.select("example_id", F.array_join(validate.response_errors("raw", 2), "|").alias("errors"))


@_query(
    f"WITH {_EX}, v AS (SELECT example_id, text, flatten([" + ", ".join(f"coalesce(labels.{k}, [])" for k in KINDS if k != "topics") + "]) AS names, coalesce(list_transform(labels.relationships, lambda r: r.subject), []) || coalesce(list_transform(labels.relationships, lambda r: r.object), []) AS ends FROM ex)"
    " SELECT example_id, len(list_filter(names, lambda n: NOT coalesce(contains(text, n), false))) AS n_names, len(list_filter(ends, lambda n: NOT coalesce(contains(text, n), false))) AS n_ends FROM v"
)
def ungrounded_labels(spark: SparkSession, d: str) -> DataFrame:
    """How many of each example's names, and of its relationships' ends, do not stand in its text."""
    none = F.array().cast("array<string>")
    names = F.flatten(F.array(*[F.coalesce(f"labels.{k}", none) for k in KINDS if k != "topics"]))
    ends = F.concat(F.coalesce(F.col("labels.relationships.subject"), none), F.coalesce(F.col("labels.relationships.object"), none))
    return _examples(spark, d).select("example_id", F.size(validate.ungrounded("text", names)).alias("n_names"), F.size(validate.ungrounded("text", ends)).alias("n_ends"))


@_query(
    "SELECT user_id, concat_ws('|', CASE WHEN len(list_filter(map_keys(f), lambda k: k NOT IN ('countries', 'companies', 'organizations', 'profiles', 'systems'))) > 0 THEN 'unknown category' END,"
    " CASE WHEN len(list_filter(map_values(f), lambda v: v IS NULL OR len(list_filter(v, lambda x: coalesce(trim(x), '') = '')) > 0)) > 0 THEN 'names are missing or blank' END) AS errors"
    " FROM (SELECT user_id, coalesce(required_filters, interests) AS f FROM users)"
)
def filter_checks(spark: SparkSession, d: str) -> DataFrame:
    """Errors of each user's filters where topics are no category, interests standing in for missing ones."""
    u = _t(spark, d, "users").withColumn("f", F.coalesce("required_filters", "interests"))
    return u.select("user_id", F.array_join(validate.filter_errors("f", ("countries", "companies", "organizations", "profiles", "systems")), "|").alias("errors"))


@_query("SELECT doc_id, n_chars, length(trim(text)) AS recomputed FROM documents WHERE n_chars IS DISTINCT FROM length(trim(text))")
def changed_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose stored length is not that of their text without blanks at its ends."""
    return validate.disagreeing(_t(spark, d, "documents").select("doc_id", "n_chars", "text"), "n_chars", F.length(F.trim("text"))).drop("text")


@_query(
    f"WITH {_EX}, {_ALIAS}, {_LINKS}, bad AS (SELECT example_id, " + " OR ".join(f"labels.{k} IS NULL" for k in _KEYS) + " OR " + " OR ".join(f"len(list_filter(labels.{k}, lambda v: v IS NULL OR trim(v) = '')) > 0" for k in KINDS) + " OR len(list_filter(labels.relationships, lambda r: coalesce(trim(r.subject), '') = '' OR coalesce(trim(r.relation), '') = '' OR coalesce(trim(r.object), '') = '')) > 0 AS bad FROM ex),"
    " f AS (SELECT DISTINCT example_id, category, lower(trim(v)) AS name FROM (" + " UNION ALL ".join(f"SELECT example_id, '{k}' AS category, unnest(labels.{k}) AS v FROM ex" for k in KINDS if k != "topics") + ") JOIN bad USING (example_id) WHERE NOT coalesce(bad, true) AND trim(v) <> ''),"
    " g AS (SELECT DISTINCT example_id, CASE type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in linking.CATEGORIES.items()) + " END AS category, lower(trim(canonical_name)) AS name FROM links),"
    " c AS (SELECT example_id, sum((a AND b)::INT) AS tp, sum((a AND NOT b)::INT) AS fp, sum((b AND NOT a)::INT) AS fn FROM (SELECT example_id, coalesce(f.h, false) AS a, coalesce(g.h, false) AS b FROM (SELECT *, true AS h FROM f) f FULL JOIN (SELECT *, true AS h FROM g) g USING (example_id, category, name)) GROUP BY 1),"
    " s AS (SELECT coalesce(language, 'all') AS language, count(*) AS examples, 1.0 AS parse_valid, round(avg((NOT bad)::INT), 6) AS schema_valid, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn FROM ex JOIN bad USING (example_id) LEFT JOIN c USING (example_id) GROUP BY ROLLUP (language))"
    " SELECT *, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall, round(2 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1 FROM s"
)
def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    """Labels, read as extractions' JSON text, against the catalogue's names in the text; malformed ones find nothing."""
    ex = _examples(spark, d)
    kind = F.create_map(*[F.lit(x) for pair in linking.CATEGORIES.items() for x in pair])
    gold = linking.phrase_matches(ex, _t(spark, d, "entities"), "example_id", "text").select("example_id", kind[F.col("type")].alias("category"), F.lower(F.trim("canonical_name")).alias("name")).distinct()
    outputs = ex.select("example_id", "language", F.to_json("labels").alias("raw"))
    return metrics.extraction_scores(outputs, gold, "example_id", "raw", validate.response_errors("raw", 2), [k for k in KINDS if k != "topics"], ["language"])


# rankings

_PLACED = "placed AS (SELECT *, article.article_id AS aid, row_number() OVER (PARTITION BY user_id, method ORDER BY score DESC, result_id) AS p, CASE WHEN direct_match THEN 2 WHEN filter_coverage > 0 THEN 1 ELSE 0 END AS grade FROM example_ranking)"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "example_ranking")
    grade = F.when(F.col("direct_match"), 2).when(F.col("filter_coverage") > 0, 1).otherwise(0)
    rows = r.select("user_id", "method", F.concat_ws(":", "user_id", "method").alias("query"), F.col("article.article_id").alias("article_id"), grade.alias("grade"), "score", "result_id", "filter_coverage")
    return sampling.group_ranks(rows, "query", [F.desc("score"), F.asc("result_id")], "p")


@_query(
    f"WITH {_PLACED}, f AS (SELECT user_id, list(DISTINCT aid) FILTER (p <= 5) AS found, list(DISTINCT aid) FILTER (grade > 0) AS wanted FROM placed WHERE method = 'hybrid' GROUP BY 1)"
    " SELECT user_id, CASE WHEN len(wanted) > 0 THEN round(len(list_intersect(coalesce(found, []), wanted)) / len(wanted), 3) ELSE 0 END AS recall FROM f"
)
def listed_recall(spark: SparkSession, d: str) -> DataFrame:
    """The share of each user's records that meet a filter among the first five of the hybrid ranking."""
    lists = _placed(spark, d).filter("method = 'hybrid'").groupBy("user_id").agg(F.collect_set(F.when(F.col("p") <= 5, F.col("article_id"))).alias("found"), F.collect_set(F.when(F.col("grade") > 0, F.col("article_id"))).alias("wanted"))
    return lists.select("user_id", metrics.recall_of_lists(F.col("found"), F.col("wanted")).alias("recall"))


@_query(f"WITH {_PLACED}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id, method ORDER BY grade DESC, p) AS q FROM placed), n AS (SELECT user_id, method, round(coalesce(sum(CASE WHEN p <= 5 THEN (2 ** grade - 1) / log2(p + 1) END) / nullif(sum(CASE WHEN q <= 5 THEN (2 ** grade - 1) / log2(q + 1) END), 0), 0), 6) AS ndcg FROM i GROUP BY 1, 2) SELECT regexp_extract(name, '^\\p{{L}}+', 0) AS role, method, count(*) AS n_users, round(avg(ndcg), 5) AS ndcg FROM n JOIN users USING (user_id) GROUP BY 1, 2")
def method_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean nDCG of each method by the users' trade."""
    m = metrics.ranking_metrics(_placed(spark, d), "query", "p", "grade").select(F.split("query", ":")[0].alias("user_id"), F.split("query", ":")[1].alias("method"), "ndcg")
    roles = _t(spark, d, "users").select("user_id", F.regexp_extract("name", r"^\p{L}+", 0).alias("role"))
    return m.join(roles, "user_id").groupBy("role", "method").agg(F.count(F.lit(1)).alias("n_users"), F.round(F.avg("ndcg"), 5).alias("ndcg"))


@_query("WITH p AS (SELECT user_id || ':' || method AS query, article.article_id AS a, count(*) AS n, count(*) FILTER (filter_coverage IS NULL) AS u FROM example_ranking GROUP BY 1, 2) SELECT query, sum(n - 1)::BIGINT AS n_repeated, sum(u)::BIGINT AS n_ungraded, 0::BIGINT AS n_odd_grades FROM p GROUP BY 1 HAVING sum(n - 1) + sum(u) > 0")
def ranking_faults(spark: SparkSession, d: str) -> DataFrame:
    """Rankings with repeated or ungraded records."""
    rows = _placed(spark, d).withColumn("grade", F.when(F.col("filter_coverage").isNotNull(), F.col("grade")))
    return metrics.ranking_faults(rows, "query", "article_id", "grade")


@_query("WITH f AS (SELECT user_id, method, article.article_id AS a, max(score) AS s FROM example_ranking WHERE method IN ('keyword', 'hybrid') GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY user_id, method ORDER BY s DESC, a) AS r FROM f QUALIFY r <= 5), l AS (SELECT user_id, coalesce(list(a ORDER BY r) FILTER (method = 'keyword'), []) AS b, coalesce(list(a ORDER BY r) FILTER (method = 'hybrid'), []) AS c FROM t GROUP BY 1) SELECT user_id, array_to_string(b, '|') AS before, array_to_string(c, '|') AS after, CASE WHEN len(b) = 5 AND len(c) = 5 THEN b <> c END AS changed FROM l")
def order_changes(spark: SparkSession, d: str) -> DataFrame:
    """The first five records of each user by keyword and by hybrid ranking, and whether they differ."""
    r = _t(spark, d, "example_ranking").select("user_id", "method", F.col("article.article_id").alias("article_id"), (-F.col("score")).alias("s"))
    got = sampling.order_changes(r, "user_id", "method", "article_id", "s", "keyword", "hybrid")
    return got.select("user_id", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"), "changed")


@_query("SELECT user_id, arg_max(method, (score, result_id)) AS method, max(score) AS score FROM example_ranking GROUP BY 1")
def best_methods(spark: SparkSession, d: str) -> DataFrame:
    """The method of each user's best result, the last one at ties."""
    r = _t(spark, d, "example_ranking")
    return r.groupBy("user_id").agg(F.max_by("method", F.struct("score", "result_id")).alias("method"), F.max("score").alias("score"))


# keyed indexes


def _index(spark: SparkSession, d: str) -> str:
    """An index of vectors by label, in which those of a positive first number were saved a second time."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("identity"), F.lit(1).alias("version"))
    index.save(e, path, "vec_id", "identity", "vector", "version")
    index.save(e.filter(F.col("vector")[0] > 0).withColumn("version", F.lit(2)), path, "vec_id", "identity", "vector", "version")
    return path


_STORED = "st AS (SELECT vec_id, 'label-' || label AS identity, CASE WHEN embedding[1] > 0 THEN 2 ELSE 1 END AS version FROM embeddings WHERE abs(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) - 1) < 1e-3)"


@_query(f"WITH {_STORED} SELECT vec_id, identity, version FROM st WHERE identity = 'label-3'")
def index_collection(spark: SparkSession, d: str) -> DataFrame:
    """The rows of one identity of a keyed index after two saves: one partition is read."""
    return index.collection(spark, _index(spark, d), "identity", "label-3").select("vec_id", "identity", "version")


@_query(f"WITH {_STORED} SELECT vec_id, version FROM st WHERE vec_id IN (SELECT user_id FROM events)")
def index_look_ups(spark: SparkSession, d: str) -> DataFrame:
    """The indexed rows of many keys at once."""
    return index.looked_up(spark, _index(spark, d), _t(spark, d, "events").select(F.col("user_id").alias("vec_id")), "vec_id").select("vec_id", "version")


@_query(f"WITH {_STORED} SELECT vec_id, version FROM st WHERE identity = 'label-1' AND vec_id IN (SELECT user_id FROM events)")
def compacted_index(spark: SparkSession, d: str) -> DataFrame:
    """One identity of an index, written anew without the rows whose key nothing uses any more."""
    to = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.compacted(spark, _index(spark, d), to, "identity", "label-1", _t(spark, d, "events").select(F.col("user_id").alias("vec_id")), "vec_id")
    return spark.read.parquet(to).select("vec_id", "version")


@_query("SELECT coalesce(CASE WHEN trim(article.license_id) <> '' THEN article.license_id END, 'legacy-unversioned:' || cache_key) AS identity, count(*) AS n FROM example_ranking GROUP BY 1")
def row_identities(spark: SparkSession, d: str) -> DataFrame:
    """Results by an identity that rows without one get from their key."""
    r = _t(spark, d, "example_ranking").select("cache_key", F.col("article.license_id").alias("identity"))
    return index.identified(r, "cache_key", "identity").groupBy("identity").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "WITH t AS (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL), c AS (SELECT sha256(title) AS text_hash, list_transform(range(32), lambda i: len(list_filter(string_split(lower(title), ''), lambda c: c <> '' AND unicode(c) % 32 = i))::DOUBLE) AS v FROM t), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM c WHERE list_sum(v) > 0)"
    " SELECT text_hash, i::INT AS dim, round(v[i + 1] / norm, 5) AS x FROM n, (SELECT unnest(range(32)) AS i)"
)
def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all titles, those of English ones taken from what an earlier run had made."""
    docs, encode = _t(spark, d, "documents"), index.letter_counts()
    nothing = spark.createDataFrame([], "text_hash string, encoder string, vector array<double>")
    held = staged(index.encoded(docs.filter("lang = 'en'"), "title", nothing, encode, "letters-32"))
    got = index.encoded(docs, "title", held, encode, "letters-32")
    return got.select("text_hash", F.posexplode("vector").alias("dim", "x")).select("text_hash", "dim", F.round("x", 5).alias("x"))


# audits and consistency

_SPLIT = "CASE WHEN lower(trim(split)) IN ('val', 'dev') THEN 'validation' ELSE lower(trim(split)) END"


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    split = F.lower(F.trim("split"))
    return _t(spark, d, "domain_corpus_sample").withColumns({"split": F.when(split.isin("val", "dev"), "validation").otherwise(split), "fingerprint": T.fingerprint("title", "text")})


@_query(
    f"WITH c AS (SELECT *, {_SPLIT} AS sp, {_FP} AS fp FROM domain_corpus_sample), h AS (SELECT * FROM c WHERE sp IN ('validation', 'test'))"
    " SELECT record_id, concat_ws('|', CASE WHEN a THEN 'document_id' END, CASE WHEN b THEN 'fingerprint' END, CASE WHEN u THEN 'source_url' END) AS ways FROM (SELECT record_id, document_id IS NOT NULL AND document_id IN (SELECT document_id FROM h WHERE document_id IS NOT NULL) AS a, fp IN (SELECT fp FROM h) AS b, source_url IS NOT NULL AND source_url IN (SELECT source_url FROM h WHERE source_url IS NOT NULL) AS u FROM c WHERE sp = 'train') WHERE a OR b OR u"
)
def training_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Training records that share a document, a content or an address with a held-out one."""
    c = staged(_corpus(spark, d).select("record_id", "split", "document_id", "fingerprint", "source_url"))
    got = tables.leaks(c.filter("split = 'train'"), c.filter("split in ('validation', 'test')"), "record_id", ["document_id", "fingerprint", "source_url"])
    return got.select("record_id", F.array_join("ways", "|").alias("ways"))


@_query(
    f"WITH c AS (SELECT record_id, document_id, {_FP} AS fp, coalesce(allowed_for_training, false) AS ok, row_number() OVER (PARTITION BY document_id ORDER BY record_id) = 1 AS single FROM domain_corpus_sample), k AS (SELECT fp, min(record_id) AS chosen FROM c WHERE ok AND single GROUP BY 1)"
    " SELECT record_id, concat_ws('|', CASE WHEN NOT ok THEN 'not eligible' END, CASE WHEN NOT single THEN 'duplicate key' END, CASE WHEN record_id > chosen THEN 'duplicate content' END) AS reasons FROM c LEFT JOIN k USING (fp)"
)
def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Why each record is left out, in the order of deliveries; an empty text means that it is selected."""
    got = tables.gated(_corpus(spark, d).select("record_id", "document_id", "fingerprint", "allowed_for_training"), "document_id", "fingerprint", "record_id", F.col("allowed_for_training"))
    return got.select("record_id", F.array_join("reasons", "|").alias("reasons"))


@_query(
    f"WITH c AS (SELECT record_id, document_id, {_FP} AS fingerprint, language, source_url FROM domain_corpus_sample), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY record_id) = 1)"
    " SELECT c.record_id, concat_ws('|', CASE WHEN c.fingerprint IS DISTINCT FROM f.fingerprint THEN 'fingerprint' END, CASE WHEN c.language IS DISTINCT FROM f.language THEN 'language' END, CASE WHEN c.source_url IS DISTINCT FROM f.source_url THEN 'source_url' END) AS errors FROM c JOIN f USING (document_id)"
    " WHERE c.fingerprint IS DISTINCT FROM f.fingerprint OR c.language IS DISTINCT FROM f.language OR c.source_url IS DISTINCT FROM f.source_url"
)
def delivery_faults(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries that differ from their document's first in content, language or address."""
    c = _corpus(spark, d).select("record_id", "document_id", "fingerprint", "language", "source_url")
    first = tables.latest(c, ["document_id"], -F.col("record_id"))
    return tables.inconsistent(c, first, "document_id", ["fingerprint", "language", "source_url"]).select("record_id", F.array_join("errors", "|").alias("errors"))


@_query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n_rows, count(DISTINCT {c}) AS n_values, count({c}) - count(DISTINCT {c}) AS n_repeated, count(*) - count({c}) AS n_missing FROM domain_corpus_sample" for c in ("record_id", "document_id", "source_url", "source_id")))
def key_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows, values, repeats and nulls of the columns that should tell records apart."""
    return tables.audit(_t(spark, d, "domain_corpus_sample"), ["record_id", "document_id", "source_url", "source_id"])


@_query(
    f"WITH c AS (SELECT lower(trim(source_id)) AS source, {_SPLIT} AS sp FROM domain_corpus_sample), h AS (SELECT source, list(DISTINCT sp) FILTER (sp IS NOT NULL) AS h FROM c GROUP BY 1), m AS (SELECT source, list_sort(list_filter(['train', 'validation', 'test'], lambda s: NOT list_contains(coalesce(h, []), s))) AS m FROM h) SELECT source, array_to_string(m, '|') AS missing FROM m WHERE len(m) > 0"
)
def missing_splits(spark: SparkSession, d: str) -> DataFrame:
    """The splits of which a source has no record."""
    got = tables.missing_values(_corpus(spark, d).select(F.lower(F.trim("source_id")).alias("source"), "split"), "source", "split", ["train", "validation", "test"])
    return got.select("source", F.array_join("missing", "|").alias("missing"))


_ARTICLE_TAGS = "tg AS (SELECT article.article_id AS article_id, result_id, flatten(list_transform(coalesce(filter_comparison, []), lambda f: coalesce(f.article, []))) AS tags, method, recorded_at FROM example_ranking)"


@_query(f"WITH {_ARTICLE_TAGS}, e AS (SELECT article_id, result_id, unnest(tags) AS t, unnest(range(len(tags))) AS i FROM tg), f AS (SELECT article_id, t, min((result_id, i)) AS o FROM e WHERE t IS NOT NULL GROUP BY 1, 2) SELECT article_id, string_agg(t, '|' ORDER BY o) AS tags FROM f GROUP BY 1")
def article_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tags that results state of each article, in the order in which they are first seen."""
    got = tables.merged_lists(_tagged(spark, d), "article_id", F.col("result_id"), "tags")
    return got.select("article_id", F.array_join("tags", "|").alias("tags"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<array<string>>")
    tags = F.flatten(F.transform(F.coalesce(F.col("filter_comparison.article"), none), lambda a: F.coalesce(a, F.array().cast("array<string>"))))
    return _t(spark, d, "example_ranking").select(F.col("article.article_id").alias("article_id"), "result_id", tags.alias("tags"), "method", "recorded_at", "direct_match")


@_query(
    f"WITH {_ARTICLE_TAGS}, a AS (SELECT article_id, arg_max(tags, result_id) AS tags FROM tg WHERE method <> 'hybrid' GROUP BY 1), o AS (SELECT article_id, arg_max(tags, (recorded_at, result_id)) AS more FROM tg WHERE method = 'hybrid' GROUP BY 1)"
    " SELECT article_id, array_to_string(list_sort(list_distinct(tags || coalesce(more, []))), '|') AS tags FROM a LEFT JOIN o USING (article_id)"
)
def article_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Articles of the plain rankings with the tags of their last hybrid result."""
    t = _tagged(spark, d)
    records = tables.latest(t.filter("method <> 'hybrid'").select("article_id", "tags", "result_id"), ["article_id"], F.col("result_id")).select("article_id", "tags")
    got = tables.with_outputs(records, t.filter("method = 'hybrid'"), "article_id", F.struct("recorded_at", "result_id"), ["tags"])
    return got.select("article_id", F.array_join("tags", "|").alias("tags"))


_FOUND_NAMES = "fo AS (SELECT DISTINCT CASE category " + " ".join(f"WHEN '{b}' THEN '{a}'" for a, b in linking.CATEGORIES.items()) + " END AS type, mention AS canonical_name, " + _WK.format("mention") + " AS k FROM m WHERE trim(mention) <> '')"


@_query(
    f"WITH {_EX}, {_MENTIONS}, {_FOUND_NAMES}, ca AS (SELECT *, {_WK.format('canonical_name')} AS k FROM entities), bn AS (SELECT k, min(entity_id) AS entity_id FROM ca GROUP BY 1),"
    " pl AS (SELECT fo.*, coalesce(bn.entity_id, 'new:' || substr(sha256('n:' || fo.k), 1, 12)) AS entity_id, bn.entity_id IS NULL AS fresh FROM fo LEFT JOIN bn USING (k)), hd AS (SELECT entity_id, min(type) AS type, min(canonical_name) AS canonical_name, NULL AS wikidata_id FROM pl WHERE fresh GROUP BY 1),"
    " ev AS (SELECT entity_id, type, canonical_name, wikidata_id FROM entities UNION ALL SELECT * FROM hd), al AS (SELECT entity_id, unnest(aliases) AS a FROM entities UNION ALL SELECT pl.entity_id, pl.canonical_name FROM pl JOIN ev USING (entity_id) WHERE ev.type = pl.type),"
    " lo AS (SELECT entity_id, lower(a) AS l, min(a) AS a FROM al WHERE trim(a) <> '' GROUP BY 1, 2), ls AS (SELECT entity_id, string_agg(a, '|' ORDER BY a) AS aliases FROM lo JOIN ev USING (entity_id) WHERE l <> lower(canonical_name) GROUP BY 1)"
    " SELECT entity_id, type, canonical_name, coalesce(aliases, '') AS aliases, wikidata_id FROM ev LEFT JOIN ls USING (entity_id)"
)
def merged_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with the labelled names: spellings as aliases, unknown names as new entities."""
    kind = F.create_map(*[F.lit(x) for a, b in linking.CATEGORIES.items() for x in (b, a)])
    names = linking.mentions(_examples(spark, d), "example_id", "text").select(kind[F.col("category")].alias("type"), F.col("mention").alias("canonical_name")).distinct()
    found = names.select("type", "canonical_name", F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("wikidata_id"))
    got = tables.merged_catalogue(_t(spark, d, "entities"), found, T.word_key("canonical_name"))
    return got.select("entity_id", "type", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "wikidata_id")


_DAY = "coalesce(try_strptime(regexp_extract(trim(published_at), '^(\\d{4}-\\d{2}-\\d{2})(?:$|[T ])', 1), '%Y-%m-%d')::DATE, try_strptime(CASE WHEN regexp_matches(trim(published_at), '^\\d{2}/\\d{2}/\\d{4}$') THEN trim(published_at) END, '%d/%m/%Y')::DATE, try_strptime(trim(published_at), '%B %d, %Y')::DATE, try_strptime(trim(published_at), '%B %d %Y')::DATE, try_strptime(trim(published_at), '%d %B %Y')::DATE)"


@_query(
    f"WITH {_ALIAS}, c AS (SELECT record_id, {_DAY} AS day, ' ' || {_WK.format('text')} || ' ' AS t FROM domain_corpus_sample), h AS (SELECT DISTINCT record_id, day, entity_id FROM c JOIN alias ON contains(t, ' ' || alias_key || ' ') WHERE day IS NOT NULL),"
    " s AS (SELECT record_id, day, string_agg(entity_id, '|' ORDER BY entity_id) AS s FROM h GROUP BY 1, 2 HAVING count(*) >= 3), f AS (SELECT *, min(record_id) OVER (PARTITION BY day, s) AS a FROM s) SELECT a, record_id AS b FROM f WHERE a <> record_id"
)
def same_stories(spark: SparkSession, d: str) -> DataFrame:
    """Records of one day that name just the same three or more entities, each with the first of them."""
    r = _t(spark, d, "domain_corpus_sample")
    found = linking.phrase_matches(r, _t(spark, d, "entities"), "record_id", "text").select("record_id", "entity_id")
    return tables.same_sets(found.join(r.select("record_id", T.parsed_date("published_at").alias("day")), "record_id"), "record_id", "day", "entity_id")


@_query(f"SELECT record_id, coalesce({_DAY}, received_at::DATE) AS date, CASE WHEN {_DAY} IS NOT NULL THEN 'publication_date' WHEN received_at IS NOT NULL THEN 'revision_date' END AS date_kind FROM domain_corpus_sample")
def record_dates(spark: SparkSession, d: str) -> DataFrame:
    """The date of each record and what it is the date of."""
    r = _t(spark, d, "domain_corpus_sample").select("record_id", T.dated("published_at", "received_at").alias("x"))
    return r.select("record_id", "x.date", "x.date_kind")


@_query("SELECT doc_id, s.domain AS source_domain, s.name AS source_name FROM documents LEFT JOIN (SELECT * FROM corpus_sources QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY name) = 1) s ON s.source_id = documents.source")
def document_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the first manifest row of its source."""
    held = _t(spark, d, "corpus_sources").select(F.col("source_id").alias("source"), F.col("domain").alias("source_domain"), F.col("name").alias("source_name"))
    return tables.first_match(_t(spark, d, "documents").select("doc_id", "source"), held, ["source"], F.col("source_name")).select("doc_id", "source_domain", "source_name")


@_query("SELECT DISTINCT document_id FROM domain_corpus_sample WHERE review_status = 'rejected' OR lower(trim(split)) = 'test' OR allowed_for_training = false")
def blocked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that at least one of several lists holds."""
    r = _t(spark, d, "domain_corpus_sample")
    lists = [r.filter("review_status = 'rejected'"), r.filter("lower(trim(split)) = 'test'"), r.filter("allowed_for_training = false")]
    return lists[0].select("document_id").union(lists[1].select("document_id")).union(lists[2].select("document_id")).distinct()


@_query("SELECT result_id, user_id, method FROM example_ranking WHERE user_id IN (SELECT user_id FROM users WHERE len(flatten(map_values(required_filters))) > 0)")
def filtered_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of the users who require something."""
    wanted = _t(spark, d, "users").filter(F.size(F.flatten(F.map_values("required_filters"))) > 0)
    return _t(spark, d, "example_ranking").select("result_id", "user_id", "method").join(wanted.select("user_id"), "user_id", "left_semi")


@_query("WITH r AS (SELECT article.article_id AS page_id, article.source_revision AS revision_id, result_id, recorded_at FROM example_ranking), l AS (SELECT page_id, arg_max(revision_id, (recorded_at, result_id)) AS revision_id FROM r GROUP BY 1) SELECT result_id FROM r JOIN l USING (page_id, revision_id)")
def current_results(spark: SparkSession, d: str) -> DataFrame:
    """Results on the revision of an article that was recorded last, joined on article and revision."""
    r = _t(spark, d, "example_ranking").select(F.col("article.article_id").alias("page_id"), F.col("article.source_revision").alias("revision_id"), "result_id", "recorded_at")
    last = tables.latest(r, ["page_id"], F.struct("recorded_at", "result_id")).select("page_id", "revision_id")
    return readers.described_pages(r, last).select("result_id")


@_query("SELECT user_id, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS clicks, round(coalesce(sum(value) FILTER (event_type = 'error'), 0), 4) AS errors, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_sums(spark: SparkSession, d: str) -> DataFrame:
    """The values of each user's events by type, as columns."""
    of = lambda t: F.round(F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("value"))), F.lit(0.0)), 4)
    return _t(spark, d, "events").groupBy("user_id").agg(of("click").alias("clicks"), of("error").alias("errors"), F.round(F.sum("value"), 4).alias("total"))


@_query("SELECT record_id, substr(sha256(lower(source_url)), 1, 16) AS url_id, coalesce(regexp_matches(source_url, '^https?://[^/\\s:?#]+'), false) AS valid FROM domain_corpus_sample WHERE source_url IS NOT NULL")
def url_ids(spark: SparkSession, d: str) -> DataFrame:
    """A short id of each record's address, and whether it is one."""
    return _t(spark, d, "domain_corpus_sample").filter("source_url is not null").select("record_id", F.substring(F.sha2(F.lower("source_url"), 256), 1, 16).alias("url_id"), F.coalesce(validate.http_url("source_url"), F.lit(False)).alias("valid"))


@_query("SELECT entity_id, array_to_string(list_filter(coalesce(aliases, []), lambda a: trim(a) <> '' AND trim(a) <> trim(canonical_name)), '|') AS names FROM entities")
def other_names(spark: SparkSession, d: str) -> DataFrame:
    """The names of each entity beside its own, read back from one text."""
    e = _t(spark, d, "entities").withColumn("listed", F.concat_ws("|||", F.array("canonical_name"), "aliases"))
    return e.select("entity_id", F.array_join(linking.split_aliases("listed", "canonical_name"), "|").alias("names"))


# orders


@_query("SELECT record_id, language, CASE WHEN row_number() OVER (PARTITION BY language ORDER BY sha256(record_id::VARCHAR), record_id) <= 5 THEN 'validation' ELSE 'test' END AS role FROM domain_corpus_sample WHERE lower(trim(split)) = 'test'")
def evaluation_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of the held-out records of each language: five for validation by a hash, the rest for test."""
    held = _t(spark, d, "domain_corpus_sample").filter("lower(trim(split)) = 'test'").select("record_id", "language")
    return sampling.evaluation_roles(held, "language", "record_id").select("record_id", "language", "role")


@_query(f"WITH {_LINK}, f AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY seq) <= 5) SELECT seq, split, place FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256(seq)) AS place FROM f) WHERE place <= 500")
def capped_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The first five linked names of each record, five hundred of each split by a hash."""
    return sampling.capped(_training_links(spark, d), "example_id", "seq", "split", F.col("seq"), 5, 500).select("seq", "split", "place")


@_query("SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY sha256('s7:' || epoch || ':' || doc_id), doc_id) AS place FROM documents, (SELECT unnest(range(1, 4))::INT AS epoch)")
def epoch_orders(spark: SparkSession, d: str) -> DataFrame:
    """Three orders of all documents, each another permutation."""
    return sampling.epoch_order(_t(spark, d, "documents"), "doc_id", 3, "s7")


@_query("WITH p AS (SELECT user_id, event_id, event_type <> 'error' AND ts < TIMESTAMP '2024-01-10' AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events), s AS (SELECT user_id, count(*) FILTER (done) = coalesce(max(place) FILTER (done), 0) AS in_order FROM p GROUP BY 1) SELECT user_id, event_id, place, in_order FROM p JOIN s USING (user_id) WHERE NOT done")
def remaining_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that are still to be handled, and whether what was handled is a beginning of their user's."""
    e = _t(spark, d, "events")
    done = e.filter("event_type <> 'error' and ts < timestamp'2024-01-10'").select("event_id")
    return sampling.remaining(e.select("user_id", "event_id", "ts"), done, "user_id", "event_id", [F.asc("ts"), F.asc("event_id")])


@_query("WITH r AS (SELECT record_id, lower(trim(split)) AS split, coalesce(len(regexp_extract_all(lower(text), 'missile|drone|radar|minister|border')), 0) AS hits FROM domain_corpus_sample) SELECT record_id, split, hits, row_number() OVER (PARTITION BY split ORDER BY hits DESC, sha256(record_id::VARCHAR), record_id) AS place FROM r")
def queue_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of each record in its split's queue: most terms of the domain first, then by a hash."""
    r = _t(spark, d, "domain_corpus_sample").select("record_id", F.lower(F.trim("split")).alias("split"), F.coalesce(F.regexp_count(F.lower("text"), F.lit("missile|drone|radar|minister|border")), F.lit(0)).alias("hits"), F.sha2(F.col("record_id").cast("string"), 256).alias("h"))
    return sampling.group_ranks(r, "split", [F.desc("hits"), F.asc("h"), F.asc("record_id")], "place").drop("h")


@_query(f"WITH c AS (SELECT record_id, document_id, {_FP} AS fp FROM domain_corpus_sample), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY record_id) = 1) SELECT record_id FROM c WHERE NOT EXISTS (FROM f WHERE f.document_id = c.document_id AND f.fp = c.fp)")
def stale_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose document is held, from its first delivery, with another content: what was kept is of no use."""
    c = _corpus(spark, d).select("record_id", "document_id", "fingerprint")
    held = tables.latest(c, ["document_id"], -F.col("record_id"))
    return tables.misses(c, held, ["document_id", "fingerprint"]).select("record_id")


@_query(f"WITH {_EX}, {_MENTIONS}, s AS (SELECT DISTINCT mention AS surface, {_WK.format('mention')} AS k FROM m WHERE trim({_WK.format('mention')}) <> ''), t AS (SELECT doc_id, ' ' || {_WK.format('text')} || ' ' AS t FROM documents) SELECT surface, count(*) AS n_documents FROM s JOIN t ON contains(t, ' ' || k || ' ') GROUP BY 1")
def surface_documents(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each labelled name stands as a whole phrase."""
    names = linking.mentions(_examples(spark, d), "example_id", "text").select("mention").distinct()
    dictionary = names.select(F.col("mention").alias("entity_id"), F.lit(None).cast("string").alias("type"), F.col("mention").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
    found = linking.phrase_matches(_t(spark, d, "documents"), dictionary, "doc_id", "text")
    return found.groupBy(F.col("entity_id").alias("surface")).agg(F.count(F.lit(1)).alias("n_documents"))


@_query("SELECT doc_id, CASE WHEN trim(text) <> '' THEN CASE WHEN trim(title) <> '' THEN 'Title: ' || trim(title) || chr(10) || chr(10) ELSE '' END || trim(text) END AS content FROM documents")
def training_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text that each document is trained on."""
    return _t(spark, d, "documents").select("doc_id", records.training_text("title", "text").alias("content"))


@_query("SELECT DISTINCT user_id, event_type FROM events")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Each user's kinds of events, once each, from a stream."""
    stream = streams.source(spark, f"{d}/events.parquet").withColumn("kind", F.concat_ws(":", "user_id", "event_type")).select("user_id", "event_type", "kind", "ts")
    return streams.drained(streams.once(stream, "kind", "ts"), "once").select("user_id", "event_type")


_BAD_LABELS = " OR ".join(f"labels.{k} IS NULL" for k in _KEYS)


@_query(f"SELECT example_id, split, CASE WHEN bad THEN 'rejected' ELSE 'accepted' END AS outcome, CASE WHEN bad THEN 'accepted' END AS original_outcome FROM (SELECT example_id, split, bool_and({_BAD_LABELS}) OVER (PARTITION BY example_id) AS bad FROM extraction_examples)")
def quarantined_examples(spark: SparkSession, d: str) -> DataFrame:
    """Examples as accepted attempts, of which those with malformed labels are rejected."""
    e = _t(spark, d, "extraction_examples")
    rows = e.select("example_id", "created_at", validate.errors(*[(f"{k} is missing", F.col(f"labels.{k}").isNotNull()) for k in _KEYS]).alias("errors"))
    return validate.quarantined(rows, e.select("example_id", "split", F.lit("accepted").alias("outcome")), "example_id", F.col("created_at"))[2]


@_query(f"WITH {_EX}, v AS (SELECT example_id, unnest(labels.systems) AS v FROM ex) SELECT example_id, string_agg(v, '|' ORDER BY {_WK.format('v')}, v) AS systems FROM v WHERE v IS NOT NULL GROUP BY 1")
def sorted_systems(spark: SparkSession, d: str) -> DataFrame:
    """The systems that each record names, sorted by their words whatever the letter case."""
    ex = _examples(spark, d).filter(F.size("labels.systems") > 0)
    return ex.select("example_id", F.array_join(T.sorted_names("labels.systems"), "|").alias("systems"))


@_query(f"WITH {_PLACED}, best AS (SELECT user_id, method, min(p) AS first_place, count(*) AS n FROM placed WHERE grade = 2 GROUP BY 1, 2) SELECT users.user_id, role, method, first_place, n FROM users JOIN best USING (user_id)")
def first_hits(spark: SparkSession, d: str) -> DataFrame:
    """For each user's case: at which place of each method's list the first record that meets all filters stands."""
    hits = _placed(spark, d).filter("grade = 2").groupBy("user_id", "method").agg(F.min("p").alias("first_place"), F.count(F.lit(1)).alias("n"))
    return _t(spark, d, "users").select("user_id", "role").join(hits, "user_id").select("user_id", "role", "method", "first_place", "n")
