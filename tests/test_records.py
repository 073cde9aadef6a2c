import json
import random

from pyspark.sql import functions as F

from strandline.functions import records as R
from strandline.operators import linker, sampling


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_projections(spark):
    df = rows(spark, "t string, b string", (" Title ", "Body"), ("same", "same "), (None, "x"), ("", None))
    got = df.select(R.distinct_parts("t", "b"), R.labelled_parts(title="t", body="b"), R.query_text("t")).collect()
    assert [r[0] for r in got] == ["Title\n\nBody", "same", "x", None]
    assert [r[1] for r in got] == ["Title: Title | Body: Body", "Title: same", "Body: x", ""]
    assert [r[2] for r in got] == ["query: Title", "query: same", None, None]


def test_messages_and_lists(spark):
    row = rows(spark, "t string, c array<string>", ('say "hi"', ["إيران"])).select(R.chat_messages("sys", "t", F.struct("c"))).first()[0]
    got = json.loads(row)
    assert [m["role"] for m in got] == ["system", "user", "assistant"] and json.loads(got[2]["content"]) == {"c": ["إيران"]}
    assert rows(spark, "t string", ("a | b\na||",)).select(R.listed("t")).first()[0] == ["a", "b"]


def test_first_object(spark):
    df = rows(spark, "t string", ('noise {bad} then {"b": {"a": 1}, "a": "é"} tail {"c": 2}',), ("none",), (None,), ("{" * 50,))
    assert [r[0] for r in df.select(R.first_object("t")).collect()] == ['{"a":"é","b":{"a":1}}', None, None, None]


def test_repaired_keys(spark):
    df = rows(spark, "t string", ('{"Countries": ["x"], "topics": []}',), ('{"countries": []}',), ('{"countries": [], "Countries": [], "topics": []}',), ("broken",))
    got = [r[0] for r in df.select(R.repaired_keys("t", ["countries", "topics"])).collect()]
    assert got == [{"countries": '["x"]', "topics": "[]"}, None, None, None]


def test_link_model_separates(spark):
    rng = random.Random(1)
    data = [(i, rng.gauss(1 if i % 3 else -1, 0.4), rng.random(), bool(i % 3), i % 2 == 0) for i in range(200)] + [(900, None, 0.1, True, True)]
    df = rows(spark, "id long, a double, b double, y boolean, train boolean", *data)
    got = {r["id"]: r for r in linker.link_scores(df, ["a", "b"], "y", "train").collect()}
    held = [r for r in got.values() if not r["train"]]
    assert sum((r["link_score"] > 0.5) == r["y"] for r in held) / len(held) > 0.9
    assert linker.link_scores(df.filter("y"), ["a", "b"], "y", "train").filter("link_score is not null").count() == 0


def test_pooled_vectors_and_plane(spark):
    df = rows(spark, "k long, g string, v array<float>", (1, "a", [3.0, 0.0]), (2, "a", [0.0, 3.0]), (3, "b", [0.0, 2.0]), (4, "b", None))
    got = {r["g"]: r["vector"] for r in linker.pooled_vectors(df, "g", "v").collect()}
    assert [round(x, 6) for x in got["a"]] == [0.707107, 0.707107] and got["b"] == [0.0, 1.0]
    flat = linker.plane(df, "k", "v", 2).collect()
    assert len(flat) == 3 and max(abs(x) for r in flat for x in r["coordinates"]) == 3.0


def test_samples_and_totals(spark):
    df = rows(spark, "g string, k long, v double", *[("a", i, 1.0) for i in range(10)], ("b", 1, 9.0), (None, 2, 1.0))
    assert {(r["g"], r["n"]) for r in sampling.hash_sample(df, "g", "k", 3).groupBy("g").agg(F.count("*").alias("n")).collect()} == {("a", 3), ("b", 1), (None, 1)}
    assert sampling.running_total(df, "g", [F.asc("k")], "v", 4.0).groupBy("g").count().filter("g = 'a'").first()["count"] == 4
    ranked = rows(spark, "q string, k string, p int, m string", ("q", "x", 1, "e5"), ("q", "y", 1, "keyword"), ("q", "y", 2, "e5"), ("q", "z", 2, "keyword"))
    assert [(r["k"], r["pool_rank"], r["from_method"]) for r in sampling.pooled(ranked, "q", "k", "p", "m", 3).orderBy("pool_rank").collect()] == [("x", 1, "e5"), ("y", 2, "keyword"), ("z", 3, "keyword")]
