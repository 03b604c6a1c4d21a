import random

import pytest
from pyspark.sql import functions as F

from tideline import session
from tideline.operators.ranks import positions
from tideline.operators import labels


@pytest.mark.parametrize("hot", [3, 10_000])
def test_salted_join(spark, hot):
    rng = random.Random(1)
    left = [(rng.choice([0, 0, 0, 1, 2, None, 5]), i) for i in range(300)]
    right = [(rng.choice([0, 0, 1, 1, 1, 3, None]), i) for i in range(200)]
    a, b = spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b int")
    want = sorted((i, j) for x, i in left for y, j in right if x is not None and x == y)
    got = session.salted_join(a, b, ["k"], F.xxhash64("a"), F.xxhash64("b"), hot=hot)
    assert got.columns == ["k", "a", "b"] and sorted((r.a, r.b) for r in got.collect()) == want
    one = b.groupBy("k").agg(F.max("b").alias("b"))
    best = {}
    for y, j in right:
        best[y] = max(best.get(y, j), j)
    got = session.salted_join(a, one, ["k"], F.xxhash64("a"), hot=hot)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((i, best[x]) for x, i in left if x is not None and x in best)
    assert session.salted_join(a.limit(0), b, ["k"], F.xxhash64("a"), F.xxhash64("b"), hot=hot).count() == 0


def test_hot_keys_are_few(spark):
    d = spark.range(1000).select((F.col("id") % 500).alias("k"))
    assert session.hot_keys(d, ["k"], hot=1).count() == 500
    many = spark.range(40_000).select((F.col("id") % 20_000).alias("k"))
    assert session.hot_keys(many, ["k"], hot=1).count() == 0  # none has more than one in HOT_KEYS of all rows


def test_cut_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Frame:
        class sparkSession:  # noqa: N801
            sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        session.cut(Frame())


def test_spread(spark, tmp_path):
    """A small scan gets a partition a core, whatever its folder is called; one of many files is left alone."""
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one file 1%"))
    d = session.spread(spark.read.parquet(str(tmp_path / "one file 1%")), "id")
    assert d.count() == 100 and d.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert session.spread(many, "id") is many


def test_positions(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i) for i in range(500)]
    d = spark.createDataFrame(rows, "h int, i int").repartition(7)
    got = {r.i: r.position for r in positions(d, ["h", "i"]).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(rows))}
    assert positions(d.limit(0), ["h", "i"]).count() == 0


def test_quantiles_by_ranks(spark, monkeypatch):
    """Beyond the size of one task the same values come from narrowed brackets, ties and nulls included."""
    rng = random.Random(3)
    x = [(rng.choice([None, float("nan"), 1.5, rng.gauss(0, 1), rng.gauss(0, 1)]), rng.choice(["a", "b", None])) for _ in range(3000)]
    d = spark.createDataFrame(x, "v double, g string")
    wanted = {f"q{int(q * 100)}": (F.col("v"), q, -9.0) for q in (0.0, 0.3, 0.7, 1.0)} | {"none": (F.lit(None).cast("double"), 0.5, 7.0)}
    want = labels.quantiles(d, wanted).first()
    monkeypatch.setattr(labels, "_FEW", 20)
    assert labels.quantiles(d, wanted, one_task=0).first() == pytest.approx(want)
    m = {r.g: r.median for r in labels.medians(d.where("not isnan(v)"), "g", "v").collect()}
    assert {r.g: r.median for r in labels.medians(d.where("not isnan(v)"), "g", "v", one_task=10).collect()} == pytest.approx(m) and len(m) == 3
