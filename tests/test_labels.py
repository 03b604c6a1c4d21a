import pytest
from pyspark.sql import functions as F

from tideline.operators import labels as L
from tideline.operators import metrics as M


def _one(spark, schema, row, *cols):
    return list(spark.createDataFrame([row], schema).select(*cols).first())


@pytest.mark.parametrize(("profile", "pre", "vol", "tag"), [
    ("train", 0.0051, 0.0, "Strong Rally"), ("train", 0.005, 0.0, "Sideways"), ("train", 0.002, 0.0, "Sideways"), ("train", 0.0021, 0.0, "Mild Rally"),
    ("train", -0.003, 0.0, "Weak Decline"), ("train", 0.001, 0.009, "High Volatility"), ("train", None, 0.0, "Market Data Missing"),
    ("context", 0.005, 0.0, "Mild Rally"), ("context", 0.0015, 0.009, "High Volatility"), ("context", -0.0011, 0.0, "Weak Decline"), ("context", 0.001, 0.0, "Sideways"),
    ("serve", 0.0101, 0.0, "Strong Rally"), ("serve", 0.01, 0.0, "Mild Rally"), ("serve", 0.003, 0.0, "Sideways"), ("serve", 0.002, 0.016, "High Volatility")])
def test_trend(spark, profile, pre, vol, tag):
    assert _one(spark, "p double, v double", (pre, vol), L.trend(F.col("p"), F.col("v"), profile)) == [tag]


def test_numbers(spark):
    d = spark.createDataFrame([(x,) for x in ("2.6%", "1,234.5", "-", "nan", "未公布", None, " -3 ")], "v string")
    assert [r[0] for r in d.select(L.number(F.col("v"))).collect()] == [2.6, 1234.5, None, None, None, None, -3.0]


def test_quantiles_and_three_classes(spark):
    d = spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.0, 2.0, 5.0, None, float("nan"))], "r double")
    t = L.quantiles(d, {"lo": (F.col("r"), 0.3, -1.0), "hi": (F.col("r"), 0.7, 1.0)})
    lo, hi = t.first()
    assert (round(lo, 6), round(hi, 6)) == (-0.8, 1.6)
    got = L.with_thresholds(d, t).select(L.three_class(F.col("r"), F.col("lo"), F.col("hi"))).collect()
    assert [r[0] for r in got] == [-1, -1, 0, 1, 1, 0, 0]
    assert list(L.quantiles(d.limit(0), {"lo": (F.col("r"), 0.3, -0.001)}).first()) == [-0.001]


def test_split_bounds(spark):
    d = spark.createDataFrame([(x,) for x in ("2025-07-31 23:59:59", "2025-08-01 00:00:00", "2025-11-01 00:00:00", "2026-02-01 00:00:00")], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [r[0] for r in d.select(L.time_split(F.col("t"), "2025-08-01", "2025-11-01", "2026-02-01")).collect()] == ["train", "val", "test", None]


def test_six_classes(spark):
    rows = [(0, 1, 1), (1, -1, 0), (-1, 0, 0), (0, 0, 0), (1, 1, 0)]
    d = spark.createDataFrame(rows, "b int, p int, w int")
    assert [r[0] for r in d.select(L.six_class(F.col("b"), F.col("p"), F.col("w"))).collect()] == [5, 4, 2, 0, 3]


def test_clip_and_softmax(spark):
    assert _one(spark, "x double", (0.2,), L.clip(F.col("x"), 0.05)) == [0.05]
    assert _one(spark, "x double", (None,), L.clip(F.col("x"), 0.05)) == [None]
    assert sum(_one(spark, "x array<double>", ([1.0, 2.0, 3.0],), L.softmax(F.col("x")))[0]) == pytest.approx(1)


def test_metrics(spark):
    d = spark.createDataFrame([(-1, -1), (0, 1), (1, 1), (1, 0)], "y int, p int")
    assert [r.f1 for r in M.per_class(d, "y", "p").orderBy("label").collect()] == [1.0, 0.0, 0.5]
    assert list(M.summary(d, "y", "p").first()) == [4, 0.5, 0.5]
    assert [tuple(r) for r in M.confusion(d, "y", "p").orderBy("label").collect()] == [(-1, 1, 0, 0), (0, 0, 0, 1), (1, 0, 1, 1)]
    w = spark.createDataFrame([(-1,)] * 10 + [(1,)] * 30, "y int")
    assert [r.weight for r in M.class_weights(w, "y").orderBy("label").collect()] == [1.333333, 0.0, 0.444444]
    assert M.per_class(d.limit(0), "y", "p").agg(F.sum("support")).first()[0] == 0


def test_top_and_other(spark):
    d = spark.createDataFrame([(c,) for c in "aaaabbbccdefg"] + [(None,)], "c string")
    got = {r.category: r.n for r in M.top_and_other(d, "c").collect()}
    assert got["a"] == 4 and got["Other"] == 4 and len(got) == 5
