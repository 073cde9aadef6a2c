"""The registered queries of the core, each over its whole tables, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import records as R
from strandline.functions import text as T
from strandline.operators import dedupe, linker, linking, metrics, neighbours, ranking, sampling, tables, validate
from strandline.streaming import streams

QUERIES: dict = {}
ORACLES: dict = {}
KINDS = list(linking.CATEGORIES.values())
NAMED = [k for k in KINDS if k != "topics"]


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "extraction_examples").dropDuplicates(["example_id"])


def _tags(c: str = "labels") -> Column:
    return F.create_map(*[x for k in KINDS for x in (F.lit(k), F.coalesce(F.col(f"{c}.{k}"), F.array().cast("array<string>")))])


def _language(c: str = "language") -> Column:
    x = F.lower(F.substring(F.col(c), 1, 2))
    return F.when(F.col(c).isNull(), "unknown").when(x.isin("en", "ar"), x).otherwise("mixed")


# SQL that several oracles begin with
_EX = "ex AS (SELECT DISTINCT ON (example_id) * FROM extraction_examples)"
_WK = "array_to_string(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), ' ')"
_TAGS = "tags AS (SELECT DISTINCT example_id, category, " + _WK.format("v") + " AS norm FROM (" + " UNION ALL ".join(f"SELECT example_id, '{k}' AS category, unnest(labels.{k}) AS v FROM ex" for k in KINDS) + ") WHERE " + _WK.format("v") + " <> '')"
_WANT = "want AS (SELECT DISTINCT user_id, category, " + _WK.format("v") + " AS norm FROM (SELECT user_id, m.key AS category, unnest(m.value) AS v FROM (SELECT user_id, unnest(map_entries(@)) AS m FROM users)) WHERE " + _WK.format("v") + " <> '')"


def _want(filters: str) -> str:
    return _WANT.replace("@", filters)


_COVER = "active AS (SELECT user_id, count(DISTINCT category) AS active FROM want GROUP BY 1), met AS (SELECT user_id, example_id, count(DISTINCT category) AS satisfied, count(*) AS matched FROM want JOIN tags USING (category, norm) GROUP BY 1, 2), cover AS (SELECT user_id, example_id, active, satisfied, matched, satisfied / active AS coverage, satisfied = active AS direct FROM met JOIN active USING (user_id))"
_TFIDF = """
terms AS (SELECT example_id, term, count(*) AS tf FROM (SELECT example_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM ex) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM ex), df AS (SELECT term, count(*) AS df FROM terms GROUP BY 1),
q AS (SELECT user_id, term, count(*) AS qtf FROM (SELECT user_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]{2,}')) AS term FROM users) GROUP BY 1, 2),
qi AS (SELECT user_id, term, qtf, ln((n + 2) / (coalesce(df, 0) + 2)) + 1 AS idf FROM q LEFT JOIN df USING (term), n),
every AS (SELECT user_id, example_id, tf, coalesce(qtf, 0) AS qtf, coalesce(qi.idf, ln((n + 2) / (df + 1)) + 1) AS idf
  FROM (SELECT DISTINCT user_id FROM q) CROSS JOIN terms JOIN df USING (term) CROSS JOIN n LEFT JOIN qi USING (user_id, term)),
sims AS (SELECT user_id, example_id, sum(tf * qtf * idf * idf) / (sqrt(sum((tf * idf) ** 2)) * any_value(qn)) AS similarity
  FROM every JOIN (SELECT user_id, sqrt(sum((qtf * idf) ** 2)) AS qn FROM qi GROUP BY 1) USING (user_id) GROUP BY 1, 2 HAVING sum(qtf) > 0)"""



def _similarities(spark: SparkSession, d: str) -> DataFrame:
    return ranking.tfidf(_t(spark, d, "users"), _examples(spark, d), "user_id", "query", "example_id", "text")


def _coverage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    required = ranking.long_tags(_t(spark, d, "users"), "user_id", F.col("required_filters"))
    return required, ranking.filter_coverage(required, ranking.long_tags(_examples(spark, d), "example_id", _tags()), "user_id", "example_id")


@_query(f"WITH {_EX}, {_TFIDF} SELECT user_id, example_id, round(similarity, 5) AS similarity, row_number() OVER (PARTITION BY user_id ORDER BY round(similarity, 5) DESC, example_id DESC) AS rank FROM sims QUALIFY rank <= 10")
def tfidf_rank(spark: SparkSession, d: str) -> DataFrame:
    """The ten records most like each user's written interest."""
    rounded = _similarities(spark, d).withColumn("similarity", F.round("similarity", 5))
    return ranking.best(rounded, ["user_id"], [F.desc("similarity"), F.desc("example_id")], 10)


@_query(f"WITH {_EX}, {_TAGS}, {_want('required_filters')}, {_COVER} SELECT user_id, example_id, active, satisfied, matched, round(coverage, 6) AS coverage, direct FROM cover")
def filter_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How far each record meets each user's required filters."""
    return _coverage(spark, d)[1].withColumn("coverage", F.round("coverage", 6))


@_query(
    f"WITH {_EX}, {_TAGS}, {_want('required_filters')}, {_COVER}, {_TFIDF}, scored AS (SELECT user_id, example_id, round(CASE WHEN a.user_id IS NOT NULL THEN 0.75 * coalesce(similarity, 0) + 0.25 * coalesce(coverage, 0) ELSE coalesce(similarity, 0) END, 5) AS score, coalesce(direct, false) AS direct, round(coalesce(coverage, 0), 5) AS coverage FROM sims FULL JOIN cover USING (user_id, example_id) LEFT JOIN active a USING (user_id))"
    " SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY direct DESC, score DESC, example_id DESC) AS rank FROM scored QUALIFY rank <= 10"
)
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    """The ten best records of each user by similarity and filter coverage together."""
    required, cover = _coverage(spark, d)
    return ranking.hybrid(_similarities(spark, d), cover, required.select("user_id"), "user_id", "example_id")


@_query(f"WITH {_EX}, {_TAGS}, {_want('interests')} SELECT user_id, example_id, category, count(*) AS n FROM want JOIN tags USING (category, norm) GROUP BY 1, 2, 3")
def exact_tags(spark: SparkSession, d: str) -> DataFrame:
    """Names that a user's interests and a record's tags share, by category."""
    wants = ranking.long_tags(_t(spark, d, "users"), "user_id", F.col("interests")).select("user_id", "category", "norm").distinct()
    tags = ranking.long_tags(_examples(spark, d), "example_id", _tags()).select("example_id", "category", "norm").distinct()
    return tags.join(wants, ["category", "norm"]).groupBy("user_id", "example_id", "category").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_EX}, {_TAGS}, {_want('CASE WHEN coalesce(len(flatten(map_values(required_filters))), 0) > 0 THEN required_filters ELSE interests END')}, {_COVER} SELECT user_id, example_id, CAST(round_even(coverage * 100, 0) AS INTEGER) AS score FROM cover")
def whole_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of required filters, or of interests where none is required, from 0 to 100."""
    some = F.coalesce(F.size(F.flatten(F.map_values("required_filters"))) > 0, F.lit(False))
    users = _t(spark, d, "users").withColumn("wanted", F.when(some, F.col("required_filters")).otherwise(F.col("interests")))
    met = ranking.filter_coverage(ranking.long_tags(users, "user_id", F.col("wanted")), ranking.long_tags(_examples(spark, d), "example_id", _tags()), "user_id", "example_id")
    return met.select("user_id", "example_id", F.bround(F.col("coverage") * 100, 0).cast("int").alias("score"))


_NEAR = "near AS (SELECT q.vec_id AS query, e.vec_id AS key, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 5) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 5) DESC, e.vec_id) AS rank FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0) q JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e ON q.vec_id <> e.vec_id QUALIFY rank <= 10)"


@_query(f"WITH {_NEAR} SELECT * FROM near")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100, against all."""
    e = _t(spark, d, "embeddings")
    return neighbours.nearest(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding")


def _neighbour_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = _t(spark, d, "embeddings").select("vec_id", "label")
    near = nearest_vectors(spark, d)
    return near.join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("gold")), "query").join(labels.select(F.col("vec_id").alias("key"), "label"), "key").withColumn("correct", F.col("label") == F.col("gold"))


_LINKED = f"WITH {_NEAR}, linked AS (SELECT near.*, g.label AS gold, l.label = g.label AS correct FROM near JOIN embeddings g ON g.vec_id = near.query JOIN embeddings l ON l.vec_id = near.key)"


@_query(_LINKED + ", pts AS (SELECT range AS i FROM range(100)), s AS (SELECT i, round(0.5 + i * 0.005, 3)::DOUBLE AS threshold, (SELECT count(*) FROM linked WHERE rank = 1 AND similarity >= 0.5 AND least(99, floor((similarity - 0.5) / 0.005 + 1e-9)) >= i) AS accepted, (SELECT count(*) FROM linked WHERE rank = 1 AND correct AND similarity >= 0.5 AND least(99, floor((similarity - 0.5) / 0.005 + 1e-9)) >= i) AS correct FROM pts) SELECT threshold, accepted, correct, CASE WHEN accepted > 0 THEN round(correct / accepted, 6) END AS precision, coalesce(i = (SELECT min(i) FROM s WHERE accepted >= 10 AND correct >= 0.9 * accepted), false) AS chosen FROM s")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Accepted and correct labels of the nearest vector at a hundred thresholds of similarity."""
    return linking.threshold_sweep(_neighbour_labels(spark, d).filter("rank = 1"), "similarity", "correct")


@_query(_LINKED + " SELECT gold AS label, count(DISTINCT query) AS n, round(avg(CASE WHEN rank = 1 THEN correct::INT END), 6) AS top1, round(count(DISTINCT CASE WHEN correct THEN query END) / count(DISTINCT query), 6) AS recall10, round(avg(correct::INT), 6) AS vote FROM linked GROUP BY 1")
def neighbour_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How often the nearest, any of ten and the average neighbour has a vector's label."""
    hit = F.col("correct").cast("int")
    rows = _neighbour_labels(spark, d).groupBy(F.col("gold").alias("label"), "query").agg(F.max(F.when(F.col("rank") == 1, hit)).alias("first"), F.max(hit).alias("any"), F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("k"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("first"), 6).alias("top1"), F.round(F.avg("any"), 6).alias("recall10"), F.round(F.sum("hits") / F.sum("k"), 6).alias("vote"))


_FP = "sha256(trim(regexp_replace(lower(concat_ws(' ', coalesce(title, ''), coalesce(text, ''))), '[\\s\\p{Z}]+', ' ', 'g')))"


@_query(f"SELECT {_FP} AS fingerprint, min(record_id) AS record_id, count(*) AS copies FROM domain_corpus_sample GROUP BY 1")
def fingerprint_copies(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each content fingerprint and its copies."""
    return dedupe.keep_first(_t(spark, d, "domain_corpus_sample").withColumn("fingerprint", T.fingerprint("title", "text")), "fingerprint", "record_id", -F.col("record_id"))


_TERMS = "missile|drone|radar|defen[sc]e|energy|minister|border|sanction|رادار|وزير|طاقة|حدود"


@_query(f"WITH r AS (SELECT {_FP} AS fingerprint, record_id, lower(substr(language, 1, 2)) = 'ar' AS ar, len(regexp_extract_all(lower(text), '{_TERMS}')) AS hits FROM domain_corpus_sample) SELECT fingerprint, record_id, coalesce(hits, 0) AS hits FROM r QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY coalesce(ar, false) DESC, coalesce(hits, 0) DESC, record_id DESC) = 1")
def priority_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Of records of one content, the one to keep: Arabic first, then most terms of the domain, then key."""
    r = _t(spark, d, "domain_corpus_sample")
    rows = r.select(T.fingerprint("title", "text").alias("fingerprint"), "record_id", F.coalesce(F.lower(F.substring("language", 1, 2)) == "ar", F.lit(False)).alias("ar"), F.coalesce(F.regexp_count(F.lower("text"), F.lit(_TERMS)), F.lit(0)).alias("hits"))
    return rows.groupBy("fingerprint").agg(F.max(F.struct("ar", "hits", "record_id")).alias("m")).select("fingerprint", "m.record_id", "m.hits")


@_query("SELECT CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split, count(*) AS n_rows, count(DISTINCT document_id) AS n_documents FROM (SELECT document_id, ('0x' || substr(sha256(document_id), 1, 8))::BIGINT % 100 AS b FROM domain_corpus_sample) GROUP BY 1")
def stable_split_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records and documents of each split that the document id alone decides."""
    return _t(spark, d, "domain_corpus_sample").groupBy(T.stable_split("document_id").alias("split")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("document_id").alias("n_documents"))


@_query(f"SELECT {_FP} AS fingerprint, count(*) AS n_rows, count(DISTINCT lower(trim(split))) AS n_splits FROM domain_corpus_sample GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1")
def split_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Contents that stand in more than one stored split."""
    r = _t(spark, d, "domain_corpus_sample").select(T.fingerprint("title", "text").alias("fingerprint"), T.trimmed_lower("split").alias("split"))
    return tables.crossing(r, "fingerprint", "split")


@_query(
    "WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),"
    " r AS (SELECT doc_id, unnest(list_distinct(list_transform(range(0, greatest(len(w) - 3, 0) + 1), lambda i: array_to_string(w[i + 1 : i + 3], ' ')))) AS run FROM w),"
    " h AS (SELECT doc_id, ('0x' || substr(md5(run), 17, 16))::UBIGINT AS h FROM r), b AS (SELECT doc_id, i, 2 * count(*) FILTER ((h >> i) & 1 = 1) >= count(*) AS bit FROM h, (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY 1, 2),"
    " s AS (SELECT doc_id, CAST(CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END AS BIGINT) AS s FROM (SELECT doc_id, sum(CASE WHEN bit THEN (1::UBIGINT << i)::HUGEINT ELSE 0 END) AS x FROM b GROUP BY 1)),"
    " d AS (SELECT DISTINCT s FROM s), e AS (SELECT a.s AS x, b.s AS y FROM d a JOIN d b ON a.s <> b.s AND bit_count(xor(a.s, b.s)) <= 3),"
    " reach AS (SELECT s AS x, s AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x), g AS (SELECT x, min(y) AS g FROM reach GROUP BY 1)"
    " SELECT documents.doc_id, s.s AS signature, g.g AS group_id FROM documents LEFT JOIN s ON s.doc_id = documents.doc_id LEFT JOIN g ON g.x = s.s"
)
def simhash_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of documents whose 64-bit similarity hashes differ in at most three bits."""
    return dedupe.simhash_groups(_t(spark, d, "documents"), "doc_id", "text")


@_query("WITH r AS (SELECT record_id, trim(published_at) AS x FROM domain_corpus_sample) SELECT record_id, coalesce(try_strptime(regexp_extract(x, '^(\\d{4}-\\d{2}-\\d{2})(?:$|[T ])', 1), '%Y-%m-%d')::DATE, try_strptime(CASE WHEN regexp_matches(x, '^\\d{2}/\\d{2}/\\d{4}$') THEN x END, '%d/%m/%Y')::DATE, try_strptime(x, '%B %d, %Y')::DATE, try_strptime(x, '%B %d %Y')::DATE, try_strptime(x, '%d %B %Y')::DATE) AS published FROM r")
def published_dates(spark: SparkSession, d: str) -> DataFrame:
    """The publication date of each record, whatever format it has."""
    return _t(spark, d, "domain_corpus_sample").select("record_id", T.parsed_date("published_at").alias("published"))


@_query("SELECT CASE WHEN lang IS NULL THEN 'unknown' ELSE lang END AS language, CASE WHEN regexp_matches(text, '[\\x{0600}-\\x{06ff}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[\\x{0600}-\\x{06ff}]') THEN 'Arabic' WHEN regexp_matches(text, '[A-Za-z]') THEN 'Latin' ELSE 'none' END AS script, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1, 2")
def script_labels(spark: SparkSession, d: str) -> DataFrame:
    """Documents by stated language and the scripts found in them."""
    return _t(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("language"), T.script_label("text").alias("script")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("long").alias("n_chars"))


@_query("SELECT regexp_extract(source_url, '^https?://([^/:?#]+)', 1) AS host, count(*) AS n, count(DISTINCT document_id) AS n_documents FROM domain_corpus_sample WHERE source_url IS NOT NULL GROUP BY 1")
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Records and documents of each host."""
    r = _t(spark, d, "domain_corpus_sample").filter("source_url is not null")
    return r.groupBy(F.regexp_extract("source_url", r"^https?://([^/:?#]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("n_documents"))


@_query("SELECT error, count(*) AS n FROM (SELECT unnest([" + ", ".join(f"CASE WHEN coalesce(length(trim({c})), 0) = 0 THEN '{c} is empty' END" for c in ("document_id", "source_id", "source_url", "published_at", "language", "title", "text", "review_status")) + ", CASE WHEN NOT coalesce(regexp_matches(source_url, '^https?://[^/\\s:?#]+'), false) THEN 'source_url is no address' END, CASE WHEN NOT coalesce(regexp_matches(published_at, '" + validate.ISO_TIME + "') AND try_strptime(substr(published_at, 1, 10), '%Y-%m-%d') IS NOT NULL, false) THEN 'published_at is no ISO time' END, CASE WHEN NOT coalesce(review_status IN ('approved', 'pending', 'rejected'), false) THEN 'review_status is of no known name' END, CASE WHEN allowed_for_training IS NULL THEN 'allowed_for_training is null' END]) AS error FROM domain_corpus_sample) WHERE error IS NOT NULL GROUP BY 1")
def document_errors(spark: SparkSession, d: str) -> DataFrame:
    """How many records fail each check."""
    r = _t(spark, d, "domain_corpus_sample")
    return r.select(F.explode(validate.document_errors(r)).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


_ALIAS = "alias AS (SELECT DISTINCT entity_id, type, canonical_name, " + _WK.format("a") + " AS alias_key FROM (SELECT entity_id, type, canonical_name, unnest(list_prepend(canonical_name, coalesce(aliases, []))) AS a FROM entities))"
_LINKS = "links AS (SELECT example_id, entity_id, type, canonical_name, count(*) AS n_aliases FROM (SELECT example_id, ' ' || " + _WK.format("text") + " || ' ' AS t FROM ex) JOIN alias ON contains(t, ' ' || alias_key || ' ') GROUP BY 1, 2, 3, 4)"


@_query(f"WITH {_EX}, {_ALIAS}, {_LINKS} SELECT * FROM links")
def phrase_links(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entities whose names stand in a record's text."""
    return linking.phrase_matches(_examples(spark, d), _t(spark, d, "entities"), "example_id", "text")


_MENTIONS = "m AS (SELECT DISTINCT example_id, text, category, mention FROM (" + " UNION ALL ".join(f"SELECT example_id, text, '{k}' AS category, unnest(labels.{k}) AS mention FROM ex" for k in KINDS) + ") WHERE mention <> '')"


@_query(f"WITH {_EX}, {_MENTIONS}, n AS (SELECT *, coalesce(CAST((length(text) - length(replace(text, mention, ''))) / length(mention) AS BIGINT), 0) AS k FROM m) SELECT example_id, category, mention, CASE WHEN instr(text, mention) > 0 THEN instr(text, mention) - 1 END AS start, CASE WHEN instr(text, mention) > 0 THEN instr(text, mention) - 1 + length(mention) END AS \"end\", k AS n_occurrences, k = 1 AS is_unique FROM n")
def mention_places(spark: SparkSession, d: str) -> DataFrame:
    """Where each labelled name first stands in its text, and whether only there."""
    return linking.mentions(_examples(spark, d), "example_id", "text")


@_query(f"WITH {_EX}, {_MENTIONS} SELECT example_id, category, mention, substr(text, CAST(greatest(0, instr(text, mention) - 1 - 180) + 1 AS BIGINT), CAST(instr(text, mention) - 1 + length(mention) + 180 - greatest(0, instr(text, mention) - 1 - 180) AS BIGINT)) AS passage FROM m WHERE instr(text, mention) > 0")
def passages(spark: SparkSession, d: str) -> DataFrame:
    """The text around each labelled name's first place."""
    ex = _examples(spark, d)
    at = linking.mentions(ex, "example_id", "text").filter("start is not null")
    return at.join(ex.select("example_id", "text"), "example_id").select("example_id", "category", "mention", T.around("text", F.col("start"), F.col("end")).alias("passage"))


@_query(f"WITH {_EX}, {_MENTIONS}, {_ALIAS}, t AS (SELECT alias_key, count(DISTINCT entity_id) AS n, min(entity_id) AS only_id FROM alias GROUP BY 1) SELECT DISTINCT mention AS surface, coalesce(n, 0) AS n_targets, CASE WHEN n = 1 THEN only_id END AS entity_id FROM m LEFT JOIN t ON t.alias_key = " + _WK.format("mention"))
def mention_targets(spark: SparkSession, d: str) -> DataFrame:
    """The entity each labelled name stands for, where it is one."""
    return linking.alias_targets(linking.mentions(_examples(spark, d), "example_id", "text"), _t(spark, d, "entities"), "mention")


@_query()
def lexical_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The ten catalogue entities whose names are most like each labelled name."""
    return linking.lexical_candidates(linking.mentions(_examples(spark, d), "example_id", "text"), _t(spark, d, "entities"), "mention")


@_query(
    f"WITH {_EX}, {_ALIAS}, {_LINKS}, t AS (SELECT example_id, regexp_replace(text, '([A-Za-z0-9_-]+)', chr(1) || '\\1' || chr(2), 'g') AS t FROM ex WHERE text IS NOT NULL),"
    " s AS (SELECT example_id, regexp_extract_all(t, '\\x01[A-Z]{2,8}(?:-[A-Z0-9]{1,8})+\\x02') || regexp_extract_all(t, '\\x01[A-Z]{3,8}\\x02') || regexp_extract_all(t, '(?:\\x01[A-Z][A-Za-z]+\\x02\\s+){1,3}\\x01[A-Z][A-Za-z]+\\x02') AS v FROM t),"
    f" f AS (SELECT example_id, pos, value, {_WK.format('value')} AS name_key FROM (SELECT example_id, unnest(range(len(v))) AS pos, trim(replace(replace(unnest(v), chr(1), ''), chr(2), '')) AS value FROM s)),"
    " n AS (SELECT example_id, name_key, arg_max(value, pos) AS value FROM f WHERE length(name_key) >= 3 GROUP BY 1, 2), k AS (SELECT DISTINCT l.example_id, a.alias_key FROM links l JOIN alias a USING (entity_id))"
    " SELECT example_id, name_key, value FROM n WHERE NOT EXISTS (FROM k WHERE k.example_id = n.example_id AND (contains(' ' || n.name_key || ' ', ' ' || k.alias_key || ' ') OR contains(' ' || k.alias_key || ' ', ' ' || n.name_key || ' ')))"
)
def unknown_names(spark: SparkSession, d: str) -> DataFrame:
    """Names by their shape that no catalogue entity of the text explains."""
    ex, ents = _examples(spark, d), _t(spark, d, "entities")
    known = linking.phrase_matches(ex, ents, "example_id", "text").join(linking.aliases(ents).select("entity_id", "alias_key"), "entity_id").select("example_id", "alias_key")
    return linking.unknown_names(ex, known, "example_id", "text")


@_query(f"WITH {_EX}, {_MENTIONS}, {_ALIAS}, l AS (SELECT entity_id, mention, sum(CASE WHEN language = 'en' THEN 3 ELSE 1 END) AS w, count(*) AS c FROM m JOIN ex USING (example_id) JOIN alias ON alias_key = {_WK.format('mention')} GROUP BY 1, 2) SELECT entity_id, arg_min(mention, (-w, mention)) AS mention, max(w)::BIGINT AS weight, sum(c)::BIGINT AS n FROM l GROUP BY 1")
def entity_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weight of each entity's most used name, English uses counting three times, and all its uses."""
    return _named_entities(spark, d)


def _named_entities(spark: SparkSession, d: str) -> DataFrame:
    ex = _examples(spark, d)
    m = linking.mentions(ex, "example_id", "text").join(ex.select("example_id", "language"), "example_id").withColumn("alias_key", T.word_key("mention"))
    return linking.weighted_mode(m.join(linking.aliases(_t(spark, d, "entities")).select("alias_key", "entity_id"), "alias_key"), "entity_id", "mention", F.when(F.col("language") == "en", 3).otherwise(1))


@_query("WITH r AS (SELECT user_id || ':' || method AS query, CASE WHEN direct_match THEN 2 WHEN filter_coverage > 0 THEN 1 ELSE 0 END AS grade, row_number() OVER (PARTITION BY user_id, method ORDER BY score DESC, result_id) AS p FROM example_ranking), i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, p) AS q FROM r) SELECT query, round(coalesce(sum(CASE WHEN p <= 5 THEN (2 ** grade - 1) / log2(p + 1) END) / nullif(sum(CASE WHEN q <= 5 THEN (2 ** grade - 1) / log2(q + 1) END), 0), 0), 6) AS ndcg, round(coalesce(count(*) FILTER (grade > 0 AND p <= 5) / nullif(count(*) FILTER (grade > 0), 0), 0), 6) AS recall, count(*) AS n_judged FROM i GROUP BY 1")
def ranking_quality(spark: SparkSession, d: str) -> DataFrame:
    """nDCG and recall at five of each user's recorded ranking by each method, graded by its filters."""
    r = _t(spark, d, "example_ranking")
    grade = F.when(F.col("direct_match"), 2).when(F.col("filter_coverage") > 0, 1).otherwise(0)
    placed = sampling.group_ranks(r.select(F.concat_ws(":", "user_id", "method").alias("query"), grade.alias("grade"), "score", "result_id"), "query", [F.desc("score"), F.asc("result_id")], "p")
    return metrics.ranking_metrics(placed, "query", "p", "grade")


_CONF = f"WITH {_EX}, {_MENTIONS}, {_ALIAS}, {_LINKS}, p AS (SELECT DISTINCT example_id, CASE type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in linking.CATEGORIES.items()) + " END AS category, " + _WK.format("canonical_name") + " AS name FROM links), g AS (SELECT DISTINCT example_id, category, " + _WK.format("mention") + " AS name FROM m WHERE category <> 'topics'), c AS (SELECT example_id, category, name, (p.hit AND g.hit) IS TRUE AS tp, g.hit IS NULL AS fp, p.hit IS NULL AS fn FROM (SELECT *, true AS hit FROM p) p FULL JOIN (SELECT *, true AS hit FROM g) g USING (example_id, category, name))"


def _confusion(spark: SparkSession, d: str) -> DataFrame:
    ex = _examples(spark, d)
    kind = F.create_map(*[F.lit(x) for pair in linking.CATEGORIES.items() for x in pair])
    found = linking.phrase_matches(ex, _t(spark, d, "entities"), "example_id", "text").select("example_id", kind[F.col("type")].alias("category"), T.word_key("canonical_name").alias("name"))
    gold = linking.mentions(ex, "example_id", "text").filter("category <> 'topics'").select("example_id", "category", T.word_key("mention").alias("name"))
    return metrics.label_confusion(found, gold, ["example_id", "category", "name"])


@_query(_CONF + ", s AS (SELECT coalesce(language, 'all') AS language, coalesce(category, 'all') AS category, sum(tp::INT)::BIGINT AS tp, sum(fp::INT)::BIGINT AS fp, sum(fn::INT)::BIGINT AS fn FROM c JOIN ex USING (example_id) GROUP BY ROLLUP (language, category)) SELECT *, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall, round(2 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1 FROM s")
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    """Micro precision, recall and F1 of catalogue names against labels, by language and category."""
    named = _confusion(spark, d).join(_examples(spark, d).select("example_id", "language"), "example_id")
    return metrics.micro_scores(named, ["language", "category"])


@_query(_CONF + " SELECT example_id, coalesce(string_agg(name, '|' ORDER BY name) FILTER (tp), '') AS correct, coalesce(string_agg(name, '|' ORDER BY name) FILTER (fn), '') AS missing, coalesce(string_agg(name, '|' ORDER BY name) FILTER (fp), '') AS extra FROM (SELECT DISTINCT example_id, name, tp, fp, fn FROM c) GROUP BY 1")
def label_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Each record's names that were found, missed and found wrongly."""
    sets = metrics.set_diagnostics(_confusion(spark, d), "example_id", "name")
    return sets.select("example_id", *[F.array_join(c, "|").alias(c) for c in ("correct", "missing", "extra")])


@_query("SELECT record_id, CASE WHEN language IS NULL THEN 'unknown' WHEN lower(substr(language, 1, 2)) IN ('en', 'ar') THEN lower(substr(language, 1, 2)) ELSE 'mixed' END AS language, row_number() OVER (PARTITION BY CASE WHEN language IS NULL THEN 'unknown' WHEN lower(substr(language, 1, 2)) IN ('en', 'ar') THEN lower(substr(language, 1, 2)) ELSE 'mixed' END ORDER BY sha256(record_id::VARCHAR)) AS turn FROM domain_corpus_sample")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Records in turns over languages: the first of each, then the second of each, to the end."""
    r = _t(spark, d, "domain_corpus_sample").select("record_id", _language().alias("language"), F.sha2(F.col("record_id").cast("string"), 256).alias("h"))
    return sampling.round_robin(r, "language", [F.asc("h")]).select("record_id", "language", "turn")


@_query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('v1' || doc_id::VARCHAR), doc_id) AS rank FROM documents QUALIFY rank <= 15")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen documents of each source by a salted hash."""
    return sampling.hash_sample(_t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 15, "v1")


@_query("WITH r AS (SELECT user_id, article.article_id AS article_id, method, row_number() OVER (PARTITION BY user_id, method ORDER BY score DESC, result_id) AS p FROM example_ranking), f AS (SELECT user_id, article_id, min(struct_pack(p := p, m := method)) AS f FROM r GROUP BY 1, 2) SELECT user_id, article_id, row_number() OVER (PARTITION BY user_id ORDER BY f, article_id) AS pool_rank, f.m AS from_method FROM f QUALIFY pool_rank <= 10")
def pooled_articles(spark: SparkSession, d: str) -> DataFrame:
    """The first ten different articles over a user's rankings by all methods."""
    r = _t(spark, d, "example_ranking").select("user_id", F.col("article.article_id").alias("article_id"), "method", "score", "result_id", F.concat_ws(":", "user_id", "method").alias("q"))
    return sampling.pooled(sampling.group_ranks(r, "q", [F.desc("score"), F.asc("result_id")], "p"), "user_id", "article_id", "p", "method")


@_query("SELECT user_id, event_id, round(running, 4) AS running FROM (SELECT *, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM events) WHERE running <= 250")
def running_budget(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as long as their values sum to no more than 250."""
    return sampling.running_total(_t(spark, d, "events"), "user_id", [F.asc("ts"), F.asc("event_id")], "value", 250).select("user_id", "event_id", F.round("running", 4).alias("running"))


@_query("SELECT user_id, article.article_id AS article_id, result_id, score, method FROM example_ranking QUALIFY row_number() OVER (PARTITION BY user_id, article.article_id ORDER BY recorded_at DESC, result_id DESC) = 1")
def latest_results(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last recorded result for each article."""
    r = _t(spark, d, "example_ranking").select("user_id", F.col("article.article_id").alias("article_id"), "result_id", "score", "method", "recorded_at")
    return tables.latest(r, ["user_id", "article_id"], F.struct("recorded_at", "result_id")).drop("recorded_at")


@_query("SELECT source_id, count(*) AS n FROM domain_corpus_sample WHERE source_id IS NULL OR source_id NOT IN (SELECT source_id FROM corpus_sources) GROUP BY 1")
def unlisted_sources(spark: SparkSession, d: str) -> DataFrame:
    """Source ids as stored that the manifest does not hold."""
    return tables.misses(_t(spark, d, "domain_corpus_sample"), _t(spark, d, "corpus_sources"), ["source_id"]).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT count(*) FILTER (a.source IS NOT NULL AND b.source IS NOT NULL) AS in_both, count(*) FILTER (b.source IS NULL) AS only_left, count(*) FILTER (a.source IS NULL) AS only_right, count(*) FILTER (a.source IS NULL OR b.source IS NULL) = 0 AS equal FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) a FULL JOIN (SELECT DISTINCT source_id AS source FROM corpus_sources) b USING (source)")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the documents against those of the manifest."""
    return tables.coverage(_t(spark, d, "documents").filter("source is not null").select("source"), _t(spark, d, "corpus_sources").select(F.col("source_id").alias("source")), "source")


@_query("SELECT language, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM extraction_examples GROUP BY 1")
def language_splits(spark: SparkSession, d: str) -> DataFrame:
    """Examples by language and split, one column a split."""
    return _t(spark, d, "extraction_examples").groupBy("language").pivot("split", ["train", "validation", "test"]).count().fillna(0)


@_query("SELECT " + ", ".join(f"count(*) FILTER (len(labels.{k}) > 0) AS {k}" for k in KINDS) + ", split FROM extraction_examples GROUP BY split")
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many examples of each split have a label of each category."""
    return _t(spark, d, "extraction_examples").groupBy("split").agg(*[F.count_if(F.size(f"labels.{k}") > 0).alias(k) for k in KINDS])


@_query("SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, count(*) FILTER (domain IS NULL) AS no_domain FROM (SELECT coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, n_chars, domain FROM documents) GROUP BY GROUPING SETS ((source, lang), (source), ())")
def corpus_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters by source and language, by source, and in all."""
    r = _t(spark, d, "documents").select(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"), "n_chars", "domain")
    sums = r.groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"), F.count_if(F.col("domain").isNull()).alias("no_domain"))
    return sums.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "n", "n_chars", "no_domain")


@_query("WITH r AS (SELECT source, sha256(concat_ws(chr(31), coalesce(doc_id::VARCHAR, '\\N'), coalesce(domain::VARCHAR, '\\N'), coalesce(lang::VARCHAR, '\\N'), coalesce(n_chars::VARCHAR, '\\N'), coalesce(published_at::VARCHAR, '\\N'), coalesce(source::VARCHAR, '\\N'), coalesce(text::VARCHAR, '\\N'), coalesce(title::VARCHAR, '\\N'))) AS h FROM documents), p AS (SELECT source, count(*) AS n_rows, " + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR AS s{i}" for i in range(4)) + " FROM r GROUP BY 1) SELECT source, n_rows, sha256(s0 || '-' || s1 || '-' || s2 || '-' || s3) AS digest FROM p")
def table_digests(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each source's documents."""
    return tables.table_digest(_t(spark, d, "documents"), "source")


@_query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 448) / 416.0)) AS BIGINT) + 1)) AS chunk FROM w WHERE len(w) > 0) SELECT doc_id, chunk, len(w[chunk * 416 + 1 : chunk * 416 + 448]) AS n_words, w[chunk * 416 + 1] AS first_word FROM c")
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    """Documents in windows of 448 words, 416 apart."""
    r = _t(spark, d, "documents").select("doc_id", F.posexplode(T.windows(T.words("text"), 448, 416)).alias("chunk", "w"))
    return r.select("doc_id", "chunk", F.size("w").alias("n_words"), F.col("w")[0].alias("first_word"))


@_query("SELECT article.article_id AS article_id, count(*) AS n_results, count(DISTINCT article.body) AS n_bodies, count(DISTINCT user_id) AS n_users FROM example_ranking GROUP BY 1")
def article_versions(spark: SparkSession, d: str) -> DataFrame:
    """How often each article was ranked, and with how many different bodies."""
    return _t(spark, d, "example_ranking").groupBy(F.col("article.article_id").alias("article_id")).agg(F.count(F.lit(1)).alias("n_results"), F.count_distinct("article.body").alias("n_bodies"), F.count_distinct("user_id").alias("n_users"))


@_query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and by a number inside their JSON properties."""
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return _t(spark, d, "events").groupBy("event_type", k.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


@_query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of each day and type, counted by a stream (an extension)."""
    stream = streams.source(spark, f"{d}/events.parquet")
    return streams.drained(streams.tumbling(stream, "ts", "1 day", "event_type"), "windows", "complete")


@_query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event after a stream has been ingested."""
    stream = streams.source(spark, f"{d}/events.parquet").select("user_id", "event_id", "value")
    return streams.ingest(stream, ["user_id"], "event_id", "latest")


@_query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, s.s")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events with pauses under half an hour (an extension)."""
    return sampling.session_runs(_t(spark, d, "events"), "user_id", "ts", 30 * 60)


@_query("SELECT n_name, count(DISTINCT o_orderkey) AS n_orders, round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))), 2)::DOUBLE AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Orders and revenue of each nation's customers: a join of four tables, for the baseline."""
    t = lambda n: _t(spark, d, n)
    rows = t("lineitem").select("l_orderkey", (F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).alias("r"))
    perorder = rows.groupBy("l_orderkey").agg(F.sum("r").alias("r"))
    joined = perorder.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("r"), 2).cast("double").alias("revenue"))


_CMP = f"WITH {_EX}, {_TAGS}, {_want('required_filters')} SELECT user_id, example_id, category, string_agg(norm, '|' ORDER BY norm) AS matched FROM want JOIN tags USING (category, norm) GROUP BY 1, 2, 3"


@_query(_CMP)
def filter_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The required names that each record meets, by user and category."""
    required, tags = ranking.long_tags(_t(spark, d, "users"), "user_id", F.col("required_filters")), ranking.long_tags(_examples(spark, d), "example_id", _tags())
    met = tags.select("example_id", "category", "norm").distinct().join(required.select("user_id", "category", "norm").distinct(), ["category", "norm"])
    return met.groupBy("user_id", "example_id", "category").agg(F.array_join(F.array_sort(F.collect_set("norm")), "|").alias("matched"))


@_query("SELECT DISTINCT article.article_id AS article_id, CASE WHEN coalesce(trim(article.title), '') = '' AND coalesce(trim(article.body), '') = '' THEN NULL WHEN coalesce(trim(article.title), '') = '' OR trim(article.title) = trim(article.body) THEN trim(article.body) WHEN coalesce(trim(article.body), '') = '' THEN trim(article.title) ELSE trim(article.title) || chr(10) || chr(10) || trim(article.body) END AS content FROM example_ranking")
def article_contents(spark: SparkSession, d: str) -> DataFrame:
    """The text that an article is read as."""
    r = _t(spark, d, "example_ranking").select("article.article_id", "article.title", "article.body").distinct()
    return r.select("article_id", R.distinct_parts("title", "body").alias("content")).distinct()


@_query("WITH m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2), v AS (SELECT label, max(n) AS n, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1) SELECT m.label, v.n, i AS dim, round(m / norm, 5) AS x FROM m JOIN v USING (label)")
def label_centres(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of each label at length one, a row for each dimension."""
    pooled = linker.pooled_vectors(_t(spark, d, "embeddings"), "label", "embedding")
    return pooled.select("label", "n", F.posexplode("vector").alias("dim", "x")).select("label", "n", "dim", F.round("x", 5).alias("x"))


@_query()
def vector_map(spark: SparkSession, d: str) -> DataFrame:
    """Vectors on three principal axes."""
    return linker.plane(_t(spark, d, "embeddings"), "vec_id", "embedding")


@_query()
def neighbour_scores(spark: SparkSession, d: str) -> DataFrame:
    """How likely a neighbour has the same label, by a model trained on half of the query vectors."""
    rows = _neighbour_labels(spark, d).withColumn("train", F.col("query") % 200 == 0).withColumn("place", F.col("rank").cast("double"))
    return linker.link_scores(rows, ["similarity", "place"], "correct", "train").select("query", "key", F.round("link_score", 6).alias("link_score"), "correct")


@_query(f"WITH {_EX} SELECT example_id, to_json([struct_pack(role := 'system', content := 'List the names.'), struct_pack(role := 'user', content := text), struct_pack(role := 'assistant', content := to_json(struct_pack(countries := labels.countries, organizations := labels.organizations))::VARCHAR)])::VARCHAR AS messages FROM ex WHERE text IS NOT NULL AND labels.countries IS NOT NULL AND labels.organizations IS NOT NULL")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    """Examples as messages of a chat."""
    ex = _examples(spark, d).filter("text is not null and labels.countries is not null and labels.organizations is not null")
    return ex.select("example_id", R.chat_messages("List the names.", "text", F.struct("labels.countries", "labels.organizations")).alias("messages"))


@_query("WITH r AS (SELECT record_id, CASE WHEN lower(substr(language, 1, 2)) = 'ar' THEN 'ar' ELSE 'en' END AS lang FROM domain_corpus_sample WHERE lower(substr(language, 1, 2)) IN ('en', 'ar')), t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(record_id::VARCHAR)) AS turn FROM r), c AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM r GROUP BY lang)) SELECT record_id, lang, turn, turn <= least AS paired FROM t, c")
def paired_turns(spark: SparkSession, d: str) -> DataFrame:
    """Records of two languages side by side as far as the shorter goes, the rest after them."""
    r = _t(spark, d, "domain_corpus_sample").select("record_id", F.lower(F.substring("language", 1, 2)).alias("lang"), F.sha2(F.col("record_id").cast("string"), 256).alias("h")).filter("lang in ('en', 'ar')")
    turns = sampling.round_robin(r, "lang", [F.asc("h")])
    least = r.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    return turns.crossJoin(F.broadcast(least)).select("record_id", "lang", "turn", (F.col("turn") <= F.col("least")).alias("paired"))
