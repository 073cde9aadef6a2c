from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.functions import vectors as V


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_normalisers_differ(spark):
    got = one(spark, "  Ｆull Width—Straße  ", T.trimmed_lower("x"), T.collapsed("x"), T.word_key("x"), T.entity_key("x"))
    assert got[1] == "ｆull width—straße"
    assert got[2] == "ｆull width straße"
    assert got[3] == "full width strasse"
    assert one(spark, None, T.collapsed("x"), T.word_key("x"), T.entity_key("x")) == (None, None, None)


def test_stable_split_is_a_function_of_the_id(spark):
    rows = spark.range(2000).select(T.stable_split(F.col("id")).alias("s")).groupBy("s").count().collect()
    counts = {r["s"]: r["count"] for r in rows}
    assert 1500 < counts["train"] < 1700 and counts["validation"] + counts["test"] > 300


def test_places_and_passages(spark):
    df = spark.createDataFrame([("Iran met Iranian envoys", "Iran"), ("no name", "Iran"), ("ab", ""), (None, "x")], "t string, p string")
    got = df.select(T.first_offset("t", "p"), T.occurrences("t", "p")).collect()
    assert [tuple(r) for r in got] == [(0, 2), (None, 0), (None, None), (None, None)]
    text = "a" * 300 + "NAME" + "b" * 300
    passage = one(spark, text, T.around("x", F.lit(300), F.lit(304)))[0]
    assert len(passage) == 364 and passage[180:184] == "NAME"


def test_dates(spark):
    values = ["2024-01-02T03:04:05Z", "2024-01-02 03:04", "2024-01-02", "31/12/2023", "January 5, 2024", "5 March 2024", "yesterday", None]
    df = spark.createDataFrame([(v,) for v in values], "x string").select(T.parsed_date("x").cast("string"))
    assert [r[0] for r in df.collect()] == ["2024-01-02", "2024-01-02", "2024-01-02", "2023-12-31", "2024-01-05", "2024-03-05", None, None]


def test_windows(spark):
    got = lambda n: one(spark, " ".join(map(str, range(n))), F.transform(T.windows(T.words("x"), 4, 3), F.size))[0] if n else one(spark, "", F.size(T.windows(T.words("x"), 4, 3)))[0]
    assert got(0) == 0 and got(3) == [3] and got(4) == [4] and got(5) == [4, 2] and got(7) == [4, 4]


def test_markup(spark):
    raw = "Intro [[Paris|the city]] has {{a|{{b}}}} a '''bold''' line.\n\n[[Category:News]]\n== Sources ==\n* x"
    assert one(spark, raw, T.without_markup("x"))[0] == "Intro the city has  a bold line."


def test_script(spark):
    df = spark.createDataFrame([("abc",), ("مرحبا",), ("abc مرحبا",), ("12",)], "x string").select(T.script_label("x"))
    assert [r[0] for r in df.collect()] == ["Latin", "Arabic", "mixed", "none"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(V.dot("a", "b"), V.norm("a"), V.unit("a"), V.is_unit("b")).collect()
    assert got[0][0] == 3.0 and got[0][1] == 5.0 and got[1][2] is None and got[2][0] is None and got[0][3]
