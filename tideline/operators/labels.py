"""Features, train-only thresholds and labels as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text forms of a missing number.
NO_NUMBER = ["", "nan", "none", "null", "-", "na"]
#: Fixed values of the trend profiles: strong, mild, volatility.
TREND = {"train": (0.005, 0.002, 0.008), "context": (0.005, 0.001, 0.008), "serve": (0.01, 0.003, 0.015)}


def clip(c: Column, bound: float) -> Column:
    """To [-bound, bound]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(-bound), F.least(c, F.lit(bound))))


def number(c: Column) -> Column:
    """Text to double: percent signs, commas and zero-width blanks off; anything else is null."""
    t = F.regexp_replace(F.trim(c), "[%,​]", "")
    n = t.try_cast("double")
    return F.when(~F.lower(F.trim(c)).isin(NO_NUMBER) & ~F.isnan(n), n)


def sign(c: Column) -> Column:
    return F.coalesce(F.when(F.isnan(c), 0).otherwise(F.signum(c).cast("int")), F.lit(0))


def time_split(ts: Column, train_end: str, val_end: str, test_end: str) -> Column:
    """train, val, test by half-open bounds; null outside."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return F.when(ts < at(train_end), "train").when(ts < at(val_end), "val").when(ts < at(test_end), "test")


#: Rows up to which a quantile is one aggregate, whose final task holds all distinct values; beyond it ranks are narrowed down.
ONE_TASK = 2_000_000
#: Accuracy of the brackets, and distinct values in a bracket that are sorted by the driver.
_ACCURACY, _FEW = 10_000, 50_000


def quantiles(train: DataFrame, wanted: dict[str, tuple[Column, float, float]], one_task: int = ONE_TASK) -> DataFrame:
    """One row of exact linear-interpolation quantiles: name -> (column, q, value where there is none).

    More than ``one_task`` rows are never sorted or held as a whole: approximate
    quantiles with a known error bracket each rank, the rows below a bracket are
    counted, and the bracket is narrowed until its distinct values are few.
    """
    clean = {n: F.when(~F.isnan(c), c).cast("double") for n, (c, _, _) in wanted.items()}
    if train.limit(one_task + 1).count() <= one_task:
        return train.agg(*[F.coalesce(F.percentile(clean[n], q), F.lit(d)).alias(n) for n, (_, q, d) in wanted.items()])
    values = train.select(*[c.alias(n) for n, c in clean.items()])
    found = {n: _by_ranks(values.select(F.col(n).alias("v")), q) for n, (_, q, _) in wanted.items()}
    return train.sparkSession.createDataFrame(
        [tuple(d if found[n] is None else found[n] for n, (_, _, d) in wanted.items())], ", ".join(f"`{n}` double" for n in wanted))


def _by_ranks(values: DataFrame, q: float) -> float | None:
    """Exact quantile of the column v, by brackets around its rank."""
    v = values.where("v is not null")
    n = v.count()
    if not n:
        return None
    at = (n - 1) * q
    low, high = int(at), min(int(at) + 1, n - 1)
    below, inside = 0, v
    while True:
        few = inside.groupBy("v").count().limit(_FEW + 1).collect()
        if len(few) <= _FEW:
            break
        # ranks inside the bracket, two errors to either side
        m = inside.count()
        shares = [max(0.0, (low - below) / m - 2 / _ACCURACY), min(1.0, (high - below + 1) / m + 2 / _ACCURACY)]
        a, b = inside.agg(F.percentile_approx("v", shares, _ACCURACY).alias("x")).first()["x"]
        below += inside.where(F.col("v") < a).count()
        inside = inside.where((F.col("v") >= a) & (F.col("v") <= b))
    rank, at_rank = below, {}
    for r in sorted(few, key=lambda r: r["v"]):
        for k in (low, high):
            if rank <= k < rank + r["count"]:
                at_rank[k] = r["v"]
        rank += r["count"]
    return (high - at) * at_rank[low] + (at - low) * at_rank[high] if high > low else at_rank[low]


def medians(df: DataFrame, group: str, value: str, one_task: int = ONE_TASK) -> DataFrame:
    """(group, median): exact; groups with more than ``one_task`` rows and a hundredth of all are narrowed down one by one."""
    sizes = df.groupBy(group).agg(F.count(value).alias("n"))
    most = sizes.agg(F.greatest(F.lit(one_task), F.ceil(F.sum("n") / 100)).alias("most"))
    hot = [r[0] for r in sizes.crossJoin(F.broadcast(most)).where("n > most").select(group).collect()]  # fewer than a hundred
    same = lambda g: F.col(group).eqNullSafe(F.lit(g))
    rest = df
    for g in hot:
        rest = rest.where(~same(g))
    out = rest.groupBy(group).agg(F.median(value).alias("median"))
    kind = dict(df.dtypes)[group]
    for g in hot:
        m = _by_ranks(df.where(same(g)).select(F.col(value).cast("double").alias("v")), 0.5)
        out = out.unionAll(df.sparkSession.createDataFrame([(g, m)], f"`{group}` {kind}, median double"))
    return out


def with_thresholds(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Every row with the one row of thresholds (one row by construction, hence broadcast)."""
    return df.crossJoin(F.broadcast(thresholds))


def three_class(ret: Column, low: Column, high: Column) -> Column:
    return F.when(ret.isNull() | F.isnan(ret), 0).when(ret <= low, -1).when(ret >= high, 1).otherwise(0)


def priced_in(fundamental: Column, pre: Column, post: Column, pre_min: Column, post_min: Column) -> Column:
    big = (F.abs(pre) >= pre_min) & (F.abs(post) >= post_min)
    return F.when(big & (fundamental > 0) & (pre > 0) & (post < 0), 1).when(big & (fundamental < 0) & (pre < 0) & (post > 0), -1).otherwise(0)


def watch(range_ratio: Column, abs_ret: Column, range_min: Column, abs_max: Column) -> Column:
    return F.when((range_ratio >= range_min) & (abs_ret <= abs_max), 1).otherwise(0)


def six_class(base: Column, priced: Column, watch_: Column) -> Column:
    """watch 5, priced in 3 and 4, base 1 and 2, else 0."""
    return F.when(watch_ == 1, 5).when(priced == 1, 3).when(priced == -1, 4).when(base == 1, 1).when(base == -1, 2).otherwise(0)


def trend(pre: Column, vol: Column, profile: str) -> Column:
    """Trend tag of a named profile; they differ in bounds, in strictness and in when volatility counts."""
    strong, mild, v = TREND[profile]
    vol = F.coalesce(vol, F.lit(0.0))
    up, down = F.lit("Strong Rally"), F.lit("Sharp Decline")
    out = F.when(pre.isNull(), "Market Data Missing").when(pre > strong, up).when(pre < -strong, down)
    if profile == "train":
        return (out.when((F.abs(pre) < mild) & (vol > v), "High Volatility").when((pre > -strong) & (pre < -mild), "Weak Decline")
                .when((pre > mild) & (pre < strong), "Mild Rally").otherwise("Sideways"))
    if profile == "context":
        return out.when(vol > v, "High Volatility").when(pre > mild, "Mild Rally").when(pre < -mild, "Weak Decline").otherwise("Sideways")
    return (out.when((pre > mild) & (pre <= strong), "Mild Rally").when((pre >= -strong) & (pre < -mild), "Weak Decline")
            .when((F.abs(pre) < mild) & (vol > v), "High Volatility").otherwise("Sideways"))


def stars(star: Column) -> Column:
    """1 to 5; a missing number of stars is 1."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.nullif(star.cast("double"), F.lit(float("nan"))).cast("int"), F.lit(1))))


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
