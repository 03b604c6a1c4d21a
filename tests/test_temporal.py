from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideline.operators import temporal as T

DAY = datetime(2025, 1, 1)


def at(h, m=0, s=0, day=0):
    return DAY + timedelta(days=day, hours=h, minutes=m, seconds=s)


def _bars(spark):
    rows = [("T", at(10), 100.0, 101.0, 99.0), ("T", at(10, 1), 101.0, 102.0, 100.0), ("T", at(10, 3), 99.0, 103.0, 98.0), ("T", at(10, 5), None, 104.0, 97.0)]
    return spark.createDataFrame(rows, "ticker string, ts_utc timestamp_ntz, close double, high double, low double")


def _events(spark, times):
    return spark.createDataFrame([(i, "T", t) for i, t in enumerate(times)], "id bigint, ticker string, t timestamp_ntz")


def test_asof_takes_the_whole_row(spark):
    e = _events(spark, [at(9, 59), at(10, 1), at(10, 2, 30), at(10, 4), at(10, 5, 30), None, at(3, day=4)])
    got = {r.id: r.close for r in T.asof(e, _bars(spark), "ticker", "t", "ts_utc", ["close"]).collect()}
    assert got == {0: None, 1: 101.0, 2: 101.0, 3: 99.0, 4: None, 5: None, 6: None}


def test_asof_carries_over_blocks(spark):
    b = _bars(spark).where("close is not null")
    e = _events(spark, [at(3, day=4), at(9)]).withColumn("close", F.lit(1))
    got = {r.id: (r.close, r.asof_close) for r in T.asof(e, b, "ticker", "t", "ts_utc", ["close"]).collect()}
    assert got == {0: (1, 99.0), 1: (1, None)}


def test_interval_is_inclusive(spark):
    e = _events(spark, [at(10, 1), at(12)])
    got = T.interval_agg(e, _bars(spark).withColumn("id", F.lit(9)), "id", "ticker", "t", "ts_utc", 0, 120, [F.max("high").alias("h"), F.min("low").alias("l")]).collect()
    assert [tuple(r) for r in got] == [(0, 103.0, 98.0)]


def test_fresh(spark):
    d = spark.createDataFrame([(1, 300.0, 0.0), (2, 301.0, 0.0), (3, None, 1.0)], "id int, event_gap_s double, future_gap_s double")
    assert [r.id for r in T.fresh(d).collect()] == [1]


def test_empty(spark):
    e, b = _events(spark, [at(1)]).limit(0), _bars(spark).limit(0)
    assert T.asof(e, b, "ticker", "t", "ts_utc", ["close"]).count() == 0
    assert T.asof(_events(spark, [at(1)]), b, "ticker", "t", "ts_utc", ["close"]).first().close is None
    assert T.interval_agg(e, b, "id", "ticker", "t", "ts_utc", 0, 60, [F.count("*")]).count() == 0
