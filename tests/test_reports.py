import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import chunking
from tideline.functions import text as T
from tideline.operators import metrics, predict, retrieval, tfidf, upsert
from tideline.sources import files


def test_predicted(spark):
    """The model is asked in batches of the size given, never for nulls; an empty table never loads it."""

    def make():
        def run(texts):
            assert 0 < len(texts) <= 3 and None not in texts
            return np.array([[len(t), len(texts)] for t in texts], float)

        return run

    d = spark.createDataFrame([(i, None if i == 4 else "x" * i, 0) for i in range(8)], "k bigint, t string, scores int").coalesce(1)
    got = {r.k: r.scores for r in predict.predicted(d, "k", "t", make, batch=3).collect()}
    assert got[4] is None and [got[i][0] for i in range(8) if i != 4] == [0, 1, 2, 3, 5, 6, 7] and got[7][1] == 1
    assert predict.predicted(d.limit(0), "k", "t", lambda: 1 / 0).count() == 0
    with pytest.raises(Exception, match="one row a text"):
        predict.predicted(d, "k", "t", lambda: lambda x: np.zeros((1, 2))).collect()
    c, p = predict.best(np.array([[0.0, 1.0], [5.0, 5.0]]))
    assert c.tolist() == [1, 0] and p[1] == 0.5


@pytest.mark.parametrize(("text", "affect", "want"), [
    ("price falls and drop", "利多 金银", "bullish"), ("gain", "利空", "bearish"), ("gain", "影响较小", "neutral"), ("预期:0.3 公布:0.9", None, "bullish"), ("CPI 预期:0.3 公布:0.2", "", "bullish"),
    ("预期:0.30 公布:0.26", None, "neutral"), ("市场放缓且下滑", None, "bearish"), ("创新高", None, "bullish"), (None, None, "neutral"), ("", "x", "neutral")])
def test_mood(spark, text, affect, want):
    d = spark.createDataFrame([(text, affect)], "t string, a string")
    assert d.select(T.mood(F.col("t"), F.col("a")).alias("m")).first().m == want


def test_tables(spark):
    row = lambda *x: list(x)
    cases = [
        ([row("a", "b"), row("1", None)], True, "2行×2列表格，包含a、b"), ([row("a")], False, "1行×1列表格，包含a"), ([row(*"abcdef"), row(*"123456")], False, "2行×6列表格，包含a、b、c、d、e等"),
        ([row(None, ""), row("x" * 101, "")], False, "2行×2列表格"), ([row("", ""), row("", "")], True, "2行×2列表格"), ([row("a")] * 11, False, "11行×1列表格，包含a"), ([], False, "空表格")]
    d = spark.createDataFrame([(i, x[0]) for i, x in enumerate(cases)], "i int, r array<array<string>>")
    got = d.select("i", T.simple_table(F.col("r")).alias("s"), T.described_table(F.col("r")).alias("d")).orderBy("i").collect()
    assert [(r.s, r.d) for r in got] == [x[1:] for x in cases]


def test_file_metadata(spark):
    names = ["Goldman-x-260123.pdf", "H3_AP202601291818533670_1.pdf", "J.P.Morgan 20250406.pdf", "x.pdf", None]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = d.select("i", T.file_source(F.col("n")), T.file_language(F.col("n")), T.file_date(F.col("n"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("Goldman Sachs", "en", "2026-01-23"), ("other", "zh", "2026-01-29"), ("J.P. Morgan", "en", "2025-04-06"), ("other", "en", "unknown"), (None, None, "unknown")]


def test_report(spark):
    d = spark.createDataFrame([(-1, -1), (0, 1), (1, 1), (1, 0), (1, 7), (None, 1)], "y int, p int")
    got = {r.label: r for r in metrics.report(d, "y", "p").collect()}
    assert set(got) == {"-1", "0", "1", "7", "macro", "weighted", "accuracy"}
    assert (got["1"].precision, got["1"].recall, got["1"].support, got["7"].support) == (0.5, round(1 / 3, 6), 3, 0)
    assert got["accuracy"].f1 == 0.4 and got["weighted"].recall == 0.4 and got["macro"].f1 == 0.35
    assert metrics.report(d.limit(0), "y", "p").count() == 3


def test_responses(spark):
    body = lambda x: json.dumps(x)
    rows = [{"id": "a", "time": "1"}, {"id": "b", "time": "2"}]
    raw = [body({"data": {"list": rows}}), body(rows), body({"items": []}), body({"x": 1}), None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = d.select("i", files.response_rows(F.col("r"), "id string, time string").alias("rows")).select("i", "rows", files.next_cursor(F.col("rows")).alias("c")).orderBy("i").collect()
    assert [r.c.last_id for r in got] == ["b", "b", None, None, None] and len(got[0].rows) == 2


def test_grid_equals_the_shipped_search(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)).round(1)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>").repartition(5)
    q = c.where("id < 90").select(F.col("id").alias("query_id"), "vector")
    want = {tuple(r) for r in retrieval.nearest(q, c, 5).collect()}
    monkeypatch.setattr(retrieval, "CELL", 70)
    assert {tuple(r) for r in retrieval.nearest(q, c, 5, max_shipped=1000).collect()} == want and len(want) == 450
    assert retrieval.nearest(q, c.limit(0), 5).count() == 0 and retrieval.nearest(q, c, 0).count() == 0 and retrieval.nearest(q, c.limit(2), 5).count() == 180
    dated = c.withColumn("day", F.when(F.col("id") % 2 == 0, "2025-01-01"))
    some = retrieval.in_range(q, dated, 5, "2025-01-01", "2025-12-31")
    assert some.count() == 450 and some.where("id % 2 = 1").count() == 0
    assert retrieval.in_range(q, dated, 5, "2025-01-01", "2025-12-31", post_filter=True, fetch=1).count() < 450


def test_message_key(spark):
    d = spark.createDataFrame([("x", "t", "c"), (None, "t", "c"), (" ", "t", "c"), (None, "t", None)], "id string, t string, c string")
    got = [r[0] for r in d.select(upsert.message_key(F.col("id"), F.col("t"), F.col("c"))).collect()]
    assert got[0] == "x" and got[1] == got[2] != got[3] and got[1].startswith("auto_")


def test_chunks_use_every_separator(spark):
    t = "甲" * 300 + "！" + "乙" * 300 + "?" + "丙" * 300
    assert [len(x) for x in chunking.split(t)] == [301, 301, 300]
    d = spark.createDataFrame([(1, t), (2, " short "), (3, None), (4, ""), (5, "  ")], "i int, t string")
    got = {r.i: r.c for r in d.select("i", chunking.recursive_chunks("t").alias("c")).collect()}
    assert got == {1: chunking.split(t), 2: ["short"], 3: [], 4: [], 5: []}


def test_classifier_beats_the_largest_class(spark):
    rng = np.random.default_rng(2)
    words = [["gold", "rally", "up"], ["flat", "quiet", "calm"], ["drop", "slump", "down"]]
    y = rng.choice(3, 240, p=[0.7, 0.2, 0.1])
    d = spark.createDataFrame([(i, " ".join(rng.choice(words[c] + ["the", "market"], 6)), float(c)) for i, c in enumerate(y)], "i int, t string, y double")
    model = tfidf.linear_classifier(d.where("i < 160"), "t", "y")
    test = d.where("i >= 160").withColumn("grams", tfidf.grams(F.col("t")))
    got = {r.label: r.f1 for r in metrics.report(model.transform(test).select(F.col("y").cast("int").alias("y"), F.col("pred").cast("int").alias("p")), "y", "p").collect()}
    assert got["macro"] > 0.8
