import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import retrieval, tfidf, upsert
from tideline.plans import facade
from tideline.sources import files, pages
from tideline.streaming import windows


def _articles(spark):
    t = lambda d: datetime(2025, 1, d)
    rows = [(1, "u", "h", None, "old", t(1), t(1)), (2, "u", "h", None, "new", t(2), t(3)), (3, None, "h", None, "x", t(1), t(1)), (4, "", "h", None, "y", t(2), t(2))]
    return spark.createDataFrame([(i, u, h, p, c, a, b, "s", "q") for i, u, h, p, c, a, b in rows],
        "id bigint, url string, hash string, published_at string, content string, created_at timestamp_ntz, updated_at timestamp_ntz, site string, source string")


def test_upsert(spark):
    got = upsert.upserted(_articles(spark), upsert.article_key(), ["updated_at", "id"], "created_at").orderBy("id").collect()
    assert [(r.id, r.content, r.created_at.day) for r in got] == [(2, "new", 1), (4, "y", 1)]
    merged = upsert.merge(_articles(spark).where("id = 1"), _articles(spark).where("id = 2"), upsert.article_key(), ["updated_at", "id"], "created_at")
    assert [r.content for r in merged.collect()] == ["new"]


def test_first_seen_and_hash(spark):
    d = spark.createDataFrame([(2, None, "a"), (1, "", "b"), (3, "x", "c")], "n int, k string, v string")
    assert sorted(r.v for r in upsert.first_seen(d, [F.col("k")], ["n"]).collect()) == ["b", "c"]
    h = spark.createDataFrame([(" a\t", "b "), ("a", "b")], "t string, c string").select(upsert.content_hash(F.col("t"), F.col("c"))).distinct()
    assert h.count() == 1


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[7] = x[3]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id bigint, vector array<double>")
    q = c.where("id < 20").select(F.col("id").alias("query_id"), "vector")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.nearest(q, c, 4).collect()}
    for i in range(20):
        d = ((x - x[i]) ** 2).sum(1)
        assert [got[i, k] for k in range(1, 5)] == sorted(range(300), key=lambda j, d=d: (round(d[j], 9), j))[:4]
    assert retrieval.nearest(q, c, 0).count() == 0
    assert retrieval.nearest(q.limit(0), c, 3).count() == 0


def test_search_answers(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], "one"), (2, [0.0, 1.0], "two")], "id bigint, vector array<double>, text string")
    q = spark.createDataFrame([(5, [1.0, 0.0])], "query_id bigint, vector array<double>")
    r = facade.search(q, c, 2).first().citations
    assert [(x.id, round(x.score, 5)) for x in r] == [(1, 1.0), (2, 0.33333)]
    assert [x.id for x in facade.search(q, c, 2, F.col("id") == 2).first().citations] == [2]


def test_tfidf_norm(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["abab", "abcd", "abce", "", None])], "k int, t string")
    m = tfidf.fit(d, "k", "t", 2, 2, min_df=2)
    assert {r.term: r.df for r in m.collect()} == {"ab": 3, "bc": 2}
    w = tfidf.transform(d, m, "k", "t", 2, 2).groupBy("k").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert [round(r.s, 9) for r in w] == [1.0] * 3


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ID , Text\n1,\"a\nb\"\n2,c\n", encoding="utf-8")
    d = files.read_csv(spark, str(tmp_path / "a.csv"), ["text", "star"])
    assert d.columns == ["id", "text", "star"] and [tuple(r) for r in d.orderBy("id").collect()] == [("1", "a\nb", ""), ("2", "c", "")]
    files.write_csv(d, str(tmp_path / "out"), ["id", "text"])
    files.write_csv(d, str(tmp_path / "out"), ["id", "text"])
    assert files.read_csv(spark, str(tmp_path / "out"), []).count() == 4
    files.write_json(d, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "id string, text string").count() == 2
    (tmp_path / "arr.json").write_text(json.dumps([{"id": 1}, {"id": 2}], indent=1))
    assert files.read_json_array(spark, str(tmp_path / "arr.json"), "id int").count() == 2


def test_responses(spark):
    rows = [json.dumps(x) for x in ([{"id": 1}], {"data": {"list": [{"id": 2}, {"id": 3}]}}, {"items": [{"id": 4}]}, {"error": 1})]
    d = spark.createDataFrame([(r,) for r in rows], "raw string").select(files.response_rows(F.col("raw"), "id:int").alias("r"))
    assert [[x.id for x in r.r] if r.r else None for r in d.collect()] == [[1], [2, 3], [4], None]


def test_vectors_and_summary(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, [1.0]), (2, 1, None)], "id bigint, label int, vector array<double>")
    files.write_vectors(d, str(tmp_path / "v"), "label")
    assert spark.read.parquet(str(tmp_path / "v")).where("label = 1").count() == 1
    assert {r["column"]: r.filled for r in files.table_summary(d).collect()} == {"id": 2, "label": 2, "vector": 1}


@pytest.fixture
def events(spark):
    rows = [(i, datetime(2025, 1, 1, 0, i % 50, 5), i % 3, "view" if i % 2 else "click", float(i)) for i in range(120)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")


@pytest.mark.parametrize("fn", [windows.tumbling, windows.sliding, windows.sessions])
def test_streams_equal_tables(spark, events, tmp_path, fn):
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    # a late row far ahead moves the watermark, so that all windows before it are final
    far = [(999, datetime(2025, 1, 3), 99, "view", 0.0)]
    spark.createDataFrame(far, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    name = f"out_{fn.__name__}"
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    q = fn(stream).writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table(name).where("start < '2025-01-02'").collect()}
    want = {tuple(r) for r in fn(events).collect()}
    assert got and got <= want


def test_first_deliveries_and_sink(spark, events, tmp_path):
    twice = events.unionAll(events)
    assert windows.first_deliveries(twice, "event_id").count() == 120
    twice.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    sink = windows.upsert_sink(str(tmp_path / "t"), F.col("event_id"), lambda old, new: old.unionByName(new).dropDuplicates(["event_id"]))
    q = windows.first_deliveries(stream, "event_id").writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = windows.upserted_table(spark, str(tmp_path / "t"))
    assert got.count() == 120 and set(got.columns) == {*events.columns, "bucket"}
    sink(events.where("event_id = 7"), 5)  # one bucket has a new version, the others stay
    sink(events.where("event_id = 7"), 5)
    assert len(list((tmp_path / "t" / "version=5").glob("bucket=*"))) == 1
    assert windows.upserted_table(spark, str(tmp_path / "t")).count() == 120


def test_paged_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps({"id": i * 10 + k}) for k in range(2)))
    spark.dataSource.register(pages.PagedSource)
    q = spark.readStream.format("paged").option("path", str(tmp_path)).load().writeStream.format("memory").queryName("paged_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("paged_out").count() == 6


def test_paged_source_stops_at_the_cutoff(spark, tmp_path):
    for i, days in enumerate([("09", "08"), ("07", "05"), ("04", "03"), ("09",)]):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps({"id": d, "time": f"2025-01-{d}"}) for d in days))
    spark.dataSource.register(pages.PagedSource)
    src = spark.readStream.format("paged").option("path", str(tmp_path)).option("cutoff", "2025-01-06").load()
    src.writeStream.format("memory").queryName("paged_cut").trigger(availableNow=True).start().awaitTermination()
    assert sorted(json.loads(r.value)["id"] for r in spark.table("paged_cut").collect()) == ["07", "08", "09"]


def test_analyse_events(spark):
    bars = spark.createDataFrame([("T", datetime(2025, 1, 1, 10, m), 100.0 + m, 101.0 + m, 99.0, 100.0 + m) for m in range(3)], "ticker string, ts_utc timestamp_ntz, open double, high double, low double, close double")
    e = spark.createDataFrame([(1, "T", datetime(2025, 1, 1, 11), "gold rally"), (2, "U", datetime(2025, 1, 1, 11), None)], "id bigint, ticker string, t timestamp_ntz, text string")
    r = {x.id: x for x in facade.analyse_events(e, bars, "id", "ticker", "t", "text").collect()}
    assert r[1].context.trend_tag == "Strong Rally" and r[1].sentiment.label == 1
    assert r[2].context is None and r[2].sentiment.label == 0
