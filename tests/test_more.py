import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import index, linking, metrics, sampling, semantic, tables, validate


def test_phrases(spark):
    rows = [(1, "Track the air-defence talks of the Air-Defence Board in X"), (2, None), (3, ""), (4, "the of"), (5, "word " * 60)]
    df = spark.createDataFrame(rows, "id int, phrase string")
    got = {r["id"]: r["p"] and [(p["phrase"], p["first"], p["n"]) for p in r["p"]] for r in df.select("id", semantic.phrases("phrase").alias("p")).collect()}
    assert got[1] == [("air-defence", 2, 1), ("talks", 3, 1), ("Board", 7, 1), ("air-defence talks", 2, 2), ("Air-Defence Board", 6, 2)]
    assert got[2] is None and got[3] == [] and got[4] == [] and got[5] == [("word", 0, 1), ("word word", 0, 2)]


def test_related_tags_and_phrases(spark):
    wants = spark.createDataFrame([("u", "systems", "kite 4"), ("u", "systems", "kite 5"), ("u", "countries", "kasmar"), ("w", "countries", "zz")], "user string, category string, norm string")
    tags = spark.createDataFrame([(1, "systems", "kite 4"), (1, "systems", "kite 7"), (1, "topics", "kasmar bay"), (2, "countries", "qq")], "id int, category string, norm string")
    got = [(r["user"], r["id"], r["interest"], r["tag"]) for r in semantic.related_tags(wants, tags, "user", "id").orderBy("rank").collect()]
    # kite 4 is exact, and explains itself
    assert {("u", 1, "kite 5", "kite 7"), ("u", 1, "kasmar", "kasmar bay")} == set(got)
    q = spark.createDataFrame([("u", "naval drones near Kasmar")], "user string, q string")
    r = spark.createDataFrame([(1, "Naval drone seen; naval drones left Kasmar"), (2, None)], "id int, t string")
    pairs = [(p["query_phrase"], p["phrase"], p["similarity"]) for p in semantic.related_phrases(q, r, "user", "q", "id", "t").orderBy("rank").collect()]
    assert pairs[0] == ("naval drones", "naval drones", 1.0) and pairs[1][:2] == ("Kasmar", "Kasmar") and len(pairs) == 2


def test_whole_scores_limits_and_restrictions(spark):
    row = spark.range(1).select(semantic.percent(F.lit(0.125)).alias("a"), semantic.percent(F.lit(-1.0)).alias("b"), semantic.whole_score(F.lit(0.5), F.lit(1.0)).alias("c"), semantic.whole_score(F.lit(0.02), F.lit(0.0)).alias("d")).first()
    assert tuple(row) == (12, 0, round(0.75 * 50 + 25), round(0.75 * 2))
    df = spark.createDataFrame([("u", 1, 5), ("u", 2, 5), ("u", 3, None)], "u string, pos int, s int")
    assert [r["pos"] for r in semantic.stable_rank(df, "u", [F.desc("s")], "pos", 2).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        semantic.stable_rank(df, "u", [F.desc("s")], "pos", 101)
    assert semantic.scored_above(df, "s", 5).count() == 2
    assert semantic.restricted(df, "pos", df.filter("pos < 3").select("pos")).count() == 2
    with pytest.raises(ValueError):
        semantic.restricted(df, "pos", spark.createDataFrame([(9,)], "pos int"))


def test_index_round_trip(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", "p1", [1.0, 0.0], 1, "x"), ("b", "p1", [0.6, 0.8], 1, None), ("c", None, [1.0, 0.0], 1, "x"), ("d", "p2", [2.0, 0.0], 1, "x"), ("e", "p2", [0.0, 1.0], 1, "x"), (None, "p2", [0.0, 1.0], 1, "x")], "key string, identity string, vector array<double>, seq int, errors_note string")
    bad = {r["key"]: r["errors"] for r in index.save(rows, path, "key", "identity", "vector", "seq").collect()}
    assert bad == {"c": ["identity is empty"], "d": ["vector is not of length one"], None: ["key is empty"]}
    again = spark.createDataFrame([("b", "p1", [0.0, 1.0], 2, "new"), ("a", "p1", [0.0, 1.0], 0, "old")], rows.schema)
    for _ in range(2):
        index.save(again, path, "key", "identity", "vector", "seq")
    assert {(r["key"], r["seq"]) for r in index.collection(spark, path, "identity", "p1").collect()} == {("a", 1), ("b", 2)}
    assert index.collection(spark, path, "identity", "p2").count() == 1
    assert "PartitionFilters: [isnotnull(identity" in index.collection(spark, path, "identity", "p1")._jdf.queryExecution().toString()
    keys = spark.createDataFrame([("b",), ("b",), ("zz",), (None,)], "key string")
    assert [r["key"] for r in index.looked_up(spark, path, keys, "key").collect()] == ["b"]
    index.compacted(spark, path, str(tmp_path / "small"), "identity", "p1", keys, "key")
    assert [(r["key"], r["identity"]) for r in spark.read.parquet(str(tmp_path / "small")).collect()] == [("b", "p1")]
    assert [r["identity"] for r in index.identified(rows.filter("key = 'c'"), "key", "identity").collect()] == ["legacy-unversioned:c"]


def test_vectors_are_made_once(spark):
    texts = spark.createDataFrame([("aa",), ("aa",), ("b",), (None,)], "t string")
    made = spark.sparkContext.accumulator(0)
    held = index.encoded(texts.filter("t = 'aa'"), "t", spark.createDataFrame([], "text_hash string, encoder string, vector array<double>"), index.letter_counts(4), "v1")
    marked = held.withColumn("vector", F.array(F.lit(9.0)))
    got = index.encoded(texts, "t", marked, index.letter_counts(4), "v1").collect()
    assert sorted(len(r["vector"]) for r in got) == [1, 4] and made.value == 0
    assert index.encoded(texts, "t", marked, index.letter_counts(4), "v2").filter("size(vector) = 4").count() == 2


def test_schema_checks(spark):
    good = '{"companies":["A"],"countries":[],"organizations":[],"profiles":[],"systems":[],"topics":[],"relationships":[{"subject":"A","relation":"r","object":"B"}]}'
    cases = {
        good: [], None: ["no object"], "[1]": ["no object"], "{broken": ["no object"],
        good.replace('["A"]', '["A", " "]'): ["companies is no list of names"],
        good.replace('["A"]', "[1]"): ["companies is no list of names"],
        good.replace('["A"]', '"A"'): ["companies is no list of names"],
        good.replace('"topics":[],', ""): ["keys are not those of the schema", "topics is no list of names"],
        good.replace('"object":"B"', '"object":""'): ["relationships are malformed"],
        good.replace('"object":"B"', '"object":"B","more":"x"'): ["relationships are malformed"],
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, raw string")
    got = {r["id"]: r["e"] for r in df.select("id", validate.response_errors("raw", 2).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    three = spark.createDataFrame([(good.replace('"topics"', '"locations":["L"],"topics"'),)], "raw string")
    assert three.select(validate.response_errors("raw", 3)).first()[0] == []
    texts = spark.createDataFrame([("Alpha met Beta", ["Alpha", "beta"]), (None, ["x"]), ("y", None)], "t string, v array<string>")
    assert [r[0] for r in texts.select(validate.ungrounded("t", F.col("v"))).collect()] == [["beta"], ["x"], []]
    maps = spark.createDataFrame([({"a": ["x"]},), ({"b": ["x", " "]},), ({"a": None},), (None,)], "m map<string,array<string>>")
    assert [r[0] for r in maps.select(validate.filter_errors("m", ("a",))).collect()] == [[], ["unknown category", "names are missing or blank"], ["names are missing or blank"], []]


def test_article_and_manifest_checks(spark):
    rows = [(("", "t", "x" * 20),), ((None, None, "short"),), (("id", "t" * 501, None),)]
    df = spark.createDataFrame(rows, "article struct<article_id: string, title: string, body: string>")
    got = [tuple(r) for r in df.select(validate.article_key(), validate.article_errors()).collect()]
    assert len(got[0][0]) == 20 and got[0][1] == [] and got[1][1] == ["body is not of 20 to 15000 characters"] and got[2] == ("id", ["body is not of 20 to 15000 characters", "title is longer than 500 characters"])
    sources = spark.createDataFrame([("a", "approved", "https://a.example", None, ["model_training"]), ("b", "odd", "x", "l", None), ("b", "unknown", "https://b.example", None, ["model_training"])], "source_id string, rights_status string, homepage string, license_id string, allowed_uses array<string>")
    got = sorted((r["source_id"], len(r["errors"])) for r in validate.manifest_errors(sources).collect())
    assert got == [("a", 1), ("b", 1), ("b", 3)]
    off = validate.disagreeing(spark.createDataFrame([("ab", 2), ("c", None), (None, None)], "t string, n int"), "n", F.length("t")).collect()
    assert [(r["t"], r["recomputed"]) for r in off] == [("c", 1)]


def test_gate_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["d1", "d2", "d3", "d4", "d5", "d6", None]), rng.choice(["f1", "f2", "f3", "f4"]), rng.choice([True, True, False, None])) for i in range(60)]
    got = {r["pos"]: r["reasons"] for r in tables.gated(spark.createDataFrame(rows, "pos int, id string, fp string, ok boolean"), "id", "fp", "pos", F.col("ok")).collect()}
    ids, selected = set(), set()
    for pos, key, fp, ok in rows:
        want = [n for n, x in (("not eligible", not ok), ("duplicate key", key in ids), ("duplicate content", fp in selected)) if x]
        ids.add(key)
        assert got[pos] == want
        if not want:
            selected.add(fp)


def test_joins_and_audits(spark):
    held = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first"), ("b", 1, None)], "k string, o int, v string")
    got = {r["k"]: r["v"] for r in tables.first_match(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string"), held, ["k"], F.col("o")).collect()}
    assert got == {"a": "first", "b": None, "c": None, None: None}
    train = spark.createDataFrame([(1, "x", None), (2, "y", "g"), (3, None, None)], "id int, h string, g string")
    test = spark.createDataFrame([(9, "x", "g"), (8, None, None)], "id int, h string, g string")
    assert {r["id"]: r["ways"] for r in tables.leaks(train, test, "id", ["h", "g"]).collect()} == {1: ["h"], 2: ["g"]}
    bad = {r["id"]: r["errors"] for r in tables.inconsistent(train, spark.createDataFrame([(1, "x", "z"), (2, "y", "g")], "id int, h string, g string"), "id", ["h", "g"]).collect()}
    assert bad == {1: ["g"], 3: ["unknown"]}
    audit = {r["name"]: tuple(r)[1:] for r in tables.audit(spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "k string, n int"), ["k", "n"]).collect()}
    assert audit == {"k": (3, 1, 1, 1), "n": (3, 2, 0, 1)} and tables.audit(train.limit(0), ["id"]).first()["n_rows"] == 0
    lacking = {r["s"]: r["missing"] for r in tables.missing_values(spark.createDataFrame([("a", "train"), ("a", "test"), ("b", None)], "s string, p string"), "s", "p", ["train", "test"]).collect()}
    assert lacking == {"b": ["test", "train"]}
    lists = spark.createDataFrame([("g", 2, ["c", "a"]), ("g", 1, ["b", "a", "b", None]), ("h", 1, None)], "g string, o int, v array<string>")
    assert {r["g"]: r["v"] for r in tables.merged_lists(lists, "g", F.col("o"), "v").collect()} == {"g": ["b", "a", "c"]}
    out = spark.createDataFrame([("g", 1, ["z"], True), ("g", 2, ["y"], False)], "k string, o int, v array<string>, ok boolean")
    records = spark.createDataFrame([("g", ["x"]), ("n", None)], "k string, v array<string>")
    assert {r["k"]: r["v"] for r in tables.with_outputs(records, out, "k", F.col("o"), ["v"]).collect()} == {"g": ["x", "y"], "n": []}
    assert {r["k"]: r["v"] for r in tables.with_outputs(records, out, "k", F.col("o"), ["v"], F.col("ok")).collect()} == {"g": ["x", "z"], "n": []}
    sets = spark.createDataFrame([(i, d, v) for i, d in ((1, "m"), (2, "m"), (3, "n"), (4, "m"), (5, "m")) for v in ("a", "b", "c")[: 2 if i == 5 else 3]], "id int, d string, v string")
    assert sorted((r["a"], r["b"]) for r in tables.same_sets(sets, "id", "d", "v").collect()) == [(1, 2), (1, 4)]


def test_catalogue_merge(spark):
    schema = "entity_id string, type string, canonical_name string, aliases array<string>, wikidata_id string"
    known = spark.createDataFrame([("e1", "country", "Kasmar", ["كسمار"], "X1"), ("e2", "company", "Orin", None, None)], schema)
    found = spark.createDataFrame([("country", "KASMAR", ["Kasmara", "kasmara"], None), ("country", "Other", None, "X1"), ("country", "Orin", None, None), ("system", "Kite", ["K4"], "X9"), ("system", "Kite four", None, "X9"), ("company", " ", None, None), ("topic", "Kite five", None, "X9")], "type string, canonical_name string, aliases array<string>, wikidata_id string")
    got = {r["canonical_name"]: r for r in tables.merged_catalogue(known, found, T.word_key("canonical_name")).collect()}
    assert set(got) == {"Kasmar", "Orin", "Kite"} and len(got["Kasmar"]["aliases"]) == 3 and "Other" in got["Kasmar"]["aliases"]
    assert got["Orin"]["aliases"] == [] and got["Kite"]["aliases"] == ["K4", "Kite four"] and got["Kite"]["wikidata_id"] == "X9"


def test_orders(spark):
    rows = [("en", i) for i in range(12)] + [(None, 50), ("ar", 60)]
    roles = sampling.evaluation_roles(spark.createDataFrame(rows, "lang string, id int"), "lang", "id").collect()
    assert sum(r["role"] == "validation" for r in roles if r["lang"] == "en") == 5 and sum(r["role"] == "validation" for r in roles) == 7
    few = sampling.capped(spark.createDataFrame([(o, i, "s", f"{o}-{i}") for o in range(4) for i in range(9)], "o int, i int, s string, k string"), "o", "i", "s", F.col("k"), 5, 12).collect()
    assert len(few) == 12 and max(r["i"] for r in few) < 5
    places = {}
    for r in sampling.epoch_order(spark.range(40), "id", 2, "x").collect():
        places.setdefault(r["epoch"], {})[r["place"]] = r["id"]
    assert all(sorted(p.values()) == list(range(40)) and sorted(p) == list(range(1, 41)) for p in places.values()) and places[1] != places[2]
    df = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 10), ("b", 11), ("b", 12)], "g string, id int")
    left = {(r["g"], r["id"]): r["in_order"] for r in sampling.remaining(df, spark.createDataFrame([(0,), (1,), (11,)], "id int"), "g", "id", [F.asc("id")]).collect()}
    assert left == {("a", 2): True, ("a", 3): True, ("a", 4): True, ("a", 5): True, ("b", 10): False, ("b", 12): False}
    r = spark.createDataFrame([("u", m, f"k{i}", i if m == "x" else 9 - i) for m in ("x", "y") for i in range(9)] + [("v", "x", "k", 1)], "u string, m string, k string, p int")
    assert {r["u"]: r["changed"] for r in sampling.order_changes(r, "u", "m", "k", "p", "x", "y").collect()} == {"u": True, "v": None}


def test_running_totals_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot", i, float(rng.randrange(5))) for i in range(400)] + [(None, 1, 3.0), ("x", 1, None), ("x", 2, 99.0)]
    got = {(r["g"], r["i"]): r["running"] for r in sampling.running_total(spark.createDataFrame(rows, "g string, i int, v double").repartition(5), "g", [F.asc("i")], "v", 50).collect()}
    want, total = {}, 0.0
    for g, i, v in rows[:400]:
        total += v
        if total <= 50:
            want[g, i] = total
    assert got == {**want, (None, 1): 3.0, ("x", 1): 0.0}


def test_measures(spark):
    raw = '{{"companies":[{}],"countries":[],"organizations":[],"profiles":[],"systems":[],"topics":[],"relationships":[]}}'
    out = spark.createDataFrame([(1, "en", raw.format('"A","b "')), (2, "en", "{broken"), (3, "ar", raw.format('" "')), (4, "ar", raw.format(""))], "id int, lang string, raw string")
    gold = spark.createDataFrame([(1, "companies", "a"), (2, "companies", "x"), (3, "companies", "y"), (9, "companies", "z")], "id int, category string, name string")
    got = {r["lang"]: r for r in metrics.extraction_scores(out, gold, "id", "raw", validate.response_errors("raw", 2), ["companies", "countries"], ["lang"]).collect()}
    assert tuple(got["all"])[1:] == (4, 0.75, 0.5, 1, 1, 2, 0.5, 0.333333, 0.4)
    assert (got["ar"]["tp"], got["ar"]["fp"], got["ar"]["fn"], got["ar"]["schema_valid"]) == (0, 0, 1, 0.5)
    links = spark.createDataFrame([("en", "a", "a", "a", 1, True, True), ("en", "b", "c", None, 2, True, True), ("ar", "d", None, None, 0, False, False)], "lang string, gold string, accepted string, alias_entity string, n_aliased int, known boolean, retrieved boolean")
    rows = {r["lang"]: r for r in metrics.link_scores_of(links, ["lang"]).collect()}
    assert rows["all"]["accepted_precision"] == 0.5 and rows["all"]["unknown_abstention"] == 1.0 and rows["en"]["unknown_abstention"] is None and rows["ar"]["accepted_precision"] is None
    assert {r["lang"]: r["unknown_abstention"] for r in metrics.link_scores_of(links, ["lang"], null_empty=False).collect()}["en"] == 0.0
    faults = metrics.ranking_faults(spark.createDataFrame([("q", 1, 2), ("q", 1, 2), ("q", 2, None), ("q", 3, 7), ("ok", 1, 0)], "q string, k int, g int"), "q", "k", "g").collect()
    assert [tuple(r) for r in faults] == [("q", 1, 1, 1)]


def test_linking_by_features(spark):
    links = spark.createDataFrame([("e1", "Kasmar", "en", "port of Kasmar city", 1), ("e1", "Kasmar", "ar", "x", 2), ("e1", "Kasmari", "en", "the Kasmari port", 3), ("e2", "Qasran", "ar", "desert base", 4)], "entity_id string, surface string, language string, context string, seq int")
    catalogue = {r["entity_id"]: r for r in linking.trained_catalogue(links, "seq").collect()}
    assert catalogue["e1"]["name"] == "Kasmar" and catalogue["e1"]["context"] == "the Kasmari port" and catalogue["e2"]["context"] == "desert base" and catalogue["e1"]["n_links"] == 3
    asked = spark.createDataFrame([("m1", "kasmar", "a port"), ("m2", "Qasra", "base"), ("m3", "", None), ("m4", "zzz", "port")], "mention_id string, surface string, context string")
    features = linking.link_features(asked, linking.trained_catalogue(links, "seq"))
    first = {r["mention_id"]: r for r in features.filter("place = 1").collect()}
    assert set(first) == {"m1", "m2"} and first["m1"]["lexical"] == 1.0 and first["m1"]["entity_id"] == "e1" and first["m2"]["entity_id"] == "e2" and first["m1"]["context_score"] > 0
    scored = features.withColumn("s", linking.link_score(["mention_score", "lexical"], [0.0, 0.0], [1.0, 1.0], [1.0, 1.0], -1.0))
    assert abs(scored.filter("mention_id = 'm1' and place = 1").first()["s"] - 1 / (1 + math.exp(-(first["m1"]["mention_score"] + 1 - 1)))) < 1e-6
    got = {r["mention_id"]: (r["entity_id"], r["status"]) for r in linking.linked(scored, "s", 0.7).collect()}
    assert got["m1"] == ("e1", "linked") and got["m2"] == (None, "unresolved")
    assert linking.commonest(links, "surface", "entity_id", "seq").count() == 3
    names = spark.createDataFrame([("A|||b||| A ||||||b", "A"), (None, "x")], "l string, c string")
    assert [r[0] for r in names.select(linking.split_aliases("l", "c")).collect()] == [["b"], None]


def test_dates_and_nested_templates(spark):
    df = spark.createDataFrame([("March 5 2024", None), (None, "2023-01-02T10:00"), ("x", None)], "a string, b string")
    assert [(str(r["x"]["date"]), r["x"]["date_kind"]) for r in df.select(T.dated("a", "b").alias("x")).collect()] == [("2024-03-05", "publication_date"), ("2023-01-02", "revision_date"), ("None", None)]
    deep = "a " + "{{x|" * 7 + "y" + "}}" * 7 + " b"
    assert spark.createDataFrame([(deep,), (None,)], "t string").select(T.without_markup("t")).collect()[0][0] == "a  b"


def test_quarantine_and_training_text(spark):
    rows = spark.createDataFrame([("a", 1, ["x"]), ("a", 2, ["y"]), ("b", 1, ["z"]), ("b", 2, []), ("c", 1, [])], "k string, o int, errors array<string>")
    attempts = spark.createDataFrame([("a", "accepted"), ("a", "failed"), ("b", "accepted"), ("c", "accepted"), ("n", None)], "k string, outcome string")
    good, last, after = validate.quarantined(rows, attempts, "k", F.col("o"))
    assert sorted(r["k"] for r in good.collect()) == ["b", "c"] and {r["k"]: r["errors"] for r in last.collect()} == {"a": ["y"], "b": ["z"]}
    assert sorted(map(str, ((r["k"], r["outcome"], r["original_outcome"]) for r in after.collect()))) == sorted(map(str, [("a", "rejected", "accepted"), ("a", "failed", None), ("b", "accepted", None), ("c", "accepted", None), ("n", None, None)]))
    from strandline.functions import records

    texts = spark.createDataFrame([(" T ", "x "), (None, "x"), ("T", " "), ("T", None)], "a string, b string")
    assert [r[0] for r in texts.select(records.training_text("a", "b")).collect()] == ["Title: T\n\nx", "x", None, None]


def test_sessions_of_a_hot_group(spark):
    rng, t, times = random.Random(3), 0, []
    for _ in range(300):
        t += rng.choice([1, 5, 9, 10, 30])
        times.append(t)
    rows = [("hot", x) for x in times] + [(None, 5), (None, 6), ("x", 1), ("x", None)]
    df = spark.createDataFrame(rows, "g string, s int").select("g", F.timestamp_seconds("s").alias("t")).repartition(6)
    want, start = [], times[0]
    for a, b in zip(times, times[1:] + [10**6]):
        if b - a >= 10:
            want.append((start, a))
            start = b
    got = [(r["g"], int(r["first"].timestamp()), int(r["last"].timestamp()), r["n"]) for r in sampling.session_runs(df, "g", "t", 10).collect()]
    assert sorted((a, b) for g, a, b, _ in got if g == "hot") == want and sum(n for g, *_, n in got if g == "hot") == 300
    assert [(g, n) for g, *_, n in got if g is None] == [(None, 2)] and len([1 for g, *_ in got if g == "x"]) == 1
    assert sampling.session_runs(df.limit(0), "g", "t", 10).count() == 0
