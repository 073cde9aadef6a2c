import bz2
import json

import pytest
from pyspark.sql import functions as F

from strandline.sources import readers
from strandline.streaming import streams


def test_json_with_mark_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_bytes("﻿".encode() + json.dumps([{"k": 1}, {"k": 2}]).encode())
    assert readers.read_json(spark, str(tmp_path / "a.json"), "k int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert readers.read_articles(spark, str(tmp_path / "b.jsonl"), "k int").count() == 2
    (tmp_path / "c.jsonl").write_text('{"k": 1}\n{broken\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "c.jsonl"), "k int").collect()
    assert readers.read_jsonl(spark, str(tmp_path / "c.jsonl"), "k int", strict=False).count() == 1
    assert [(r["line"], r["value"]) for r in readers.bad_lines(spark, str(tmp_path / "c.jsonl")).collect()] == [(2, "{broken")]
    assert readers.read_or_empty(spark, str(tmp_path / "none.jsonl"), "k int").count() == 0


def test_pages(spark, tmp_path):
    page = "<mediawiki><page><title>T</title><id>7</id><revision><id>9</id><timestamp>2019</timestamp><text>body</text></revision></page></mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(page.encode()))
    assert readers.read_pages(spark, str(tmp_path / "d.xml.bz2")).first() == ("7", "T", "9", "2019", "body")


def test_versioned_and_immutable_writes(spark, tmp_path):
    df = spark.range(3)
    path = readers.write_versioned(df, str(tmp_path))
    assert readers.write_versioned(df.orderBy(F.desc("id")), str(tmp_path)) == path != readers.write_versioned(spark.range(4), str(tmp_path))
    once = str(tmp_path / "once")
    assert readers.write_once(df, once) and not readers.write_once(df.repartition(2), once)
    with pytest.raises(ValueError):
        readers.write_once(spark.range(4), once)


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", "u"), (2, None, "u")], "k int, text string, url string")
    readers.write_json(df, str(tmp_path / "j"))
    readers.write_json(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    readers.write_provenance(df, str(tmp_path / "p"), "text", ["url"])
    assert [(r["k"], r["provenance"]["url"]) for r in spark.read.json(str(tmp_path / "p")).collect()] == [(1, "u")]
    readers.log_change(str(tmp_path / "log"), df, df.filter("k = 1").withColumn("url", F.lit("v")), "k")
    log = {r["k"]: r.asDict() for r in spark.read.json(str(tmp_path / "log")).collect()}
    assert set(log) == {1, 2} and log[1]["before_hash"] != log[1]["after_hash"] and log[2].get("after_hash") is None


def test_archives_and_pages(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("en/docs.tsv", "page_id\trevision_id\n7\t9\n8\t1\n")
        z.writestr("en/other.txt", "x")
        z.writestr("ar/docs.tsv", "page_id\trevision_id\n")
    rows = readers.archive_members(spark, str(tmp_path / "a.zip"), "docs.tsv", "page_id string, revision_id string")
    assert [(r["member"], r["page_id"], r["revision_id"]) for r in rows.collect()] == [("en/docs.tsv", "7", "9"), ("en/docs.tsv", "8", "1")]
    pages = spark.createDataFrame([("7", "9", "new"), ("8", "2", "other")], "page_id string, revision_id string, wikitext string")
    assert [r["wikitext"] for r in readers.described_pages(pages, rows).collect()] == ["new"]
    found = spark.createDataFrame([("d", 5, "b"), ("d", 1, "a"), ("e", 2, None)], "doc string, start int, name string")
    assert {r["doc"]: [m["name"] for m in r["mentions"]] for r in readers.grouped_mentions(found, "doc").collect()} == {"d": ["a", "b"], "e": [None]}


def test_stream_goes_on_in_its_folder(spark, tmp_path):
    data, folder = str(tmp_path / "in"), str(tmp_path / "work")
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string").coalesce(1).write.parquet(data)
    first = streams.ingest(streams.source(spark, data), ["k"], "t", "x", folder).collect()
    spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "k int, t int, v string").coalesce(1).write.mode("append").parquet(data)
    again = {tuple(r) for r in streams.ingest(streams.source(spark, data), ["k"], "t", "x", folder).collect()}
    assert len(first) == 2 and again == {(1, 2, "c"), (2, 1, "b"), (3, 1, "d")}
    # the old file was not read a second time
    assert streams.drained(streams.source(spark, data), "x", folder=folder).count() == 4


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    readers.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p")
    readers.write_partitions(spark.createDataFrame([(3, "b")], "v int, p string"), path, "p")
    assert {tuple(r) for r in spark.read.parquet(path).select("v", "p").collect()} == {(1, "a"), (3, "b")}


def test_streams_over_several_files(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10", "a", 1.0), (1, "2024-01-01 00:40:00", "a", 2.0), (2, "2024-01-02 00:00:00", "b", 3.0)]
    df = spark.createDataFrame(rows, "user_id int, ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = streams.source(spark, str(tmp_path / "e"))
    got = streams.drained(streams.tumbling(stream, "ts", "1 day", "kind"), "t", "complete").collect()
    assert {(r["kind"], r["n"], r["total"]) for r in got} == {("a", 2, 3.0), ("b", 1, 3.0)}
    last = streams.ingest(streams.source(spark, str(tmp_path / "e")).select("user_id", "ts", "value"), ["user_id"], "ts", "l").collect()
    assert {(r["user_id"], r["value"]) for r in last} == {(1, 2.0), (2, 3.0)}
    assert streams.sessions(df, "ts", "30 minutes", "user_id").count() == 3


def test_once_and_manifests(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:20:00"), (2, "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00"), (None, "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "k int, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "e"))
    got = streams.drained(streams.once(streams.source(spark, str(tmp_path / "e")), "k", "ts"), "o").collect()
    assert sorted(str(r["k"]) for r in got) == ["1", "2", "None"]
    for run in ("a", "b"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "manifest.json").write_text(json.dumps({"name": run, "extra": 1}))
    got = readers.manifests(spark, str(tmp_path / "runs" / "*" / "manifest.json"), "name string").collect()
    assert sorted((r["name"], r["file"].rsplit("/", 2)[1]) for r in got) == [("a", "a"), ("b", "b")]
