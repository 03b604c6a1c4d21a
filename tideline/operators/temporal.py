"""As-of and interval joins between event and price streams.

Both split an entity's time into blocks, so that one entity with most of the
rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Whole and broken seconds since 1970 of a TIMESTAMP_NTZ read as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def clean_bars(prices: DataFrame) -> DataFrame:
    """Bars with NaN as null, one per (ticker, ts_utc): the lowest bar_id."""
    d = prices.where("ticker is not null and ts_utc is not null")
    value = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    first = d.groupBy("ticker", "ts_utc").agg(F.min(F.struct("bar_id", "open", "high", "low", "close", "volume")).alias("b"))
    return first.select("ticker", "ts_utc", "b.*").select(
        "bar_id", "ticker", "ts_utc", value("open"), value("high"), value("low"), value("close"), "volume")


def asof(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, take: list[str], block_seconds: int = 86400) -> DataFrame:
    """``left`` with the columns ``take`` of the last right row at or before left_ts, and ``asof_ts``.

    The whole row is taken: a null in it is not passed over for an older value.
    Rows of one block meet in a window; what a block's start needs from before
    is the last row of an earlier block, found among one row a block. Left rows
    without entity or time, or before the first right row, get nulls. A column
    of the same name on the left keeps it; the taken one becomes asof_NAME.
    """
    block = lambda c: F.floor(seconds(F.col(c)) / block_seconds).cast("bigint")
    named = [F.col(c).alias(f"asof_{c}" if c in left.columns else c) for c in take]
    row = F.struct(F.col(right_ts).alias("asof_ts"), *named)
    r = right.where(F.col(by).isNotNull() & F.col(right_ts).isNotNull()).select(
        F.col(by).alias("__by"), block(right_ts).alias("__block"), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), row.alias("__r"))
    lcols = F.struct(*left.columns)
    lf = left.select(F.col(by).alias("__by"), block(left_ts).alias("__block"), F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), lcols.alias("__l"))
    usable = F.col("__by").isNotNull() & F.col("__ts").isNotNull()
    both = lf.where(usable).unionByName(r, allowMissingColumns=True)
    w = W.partitionBy("__by", "__block").orderBy("__ts", "__side").rowsBetween(W.unboundedPreceding, 0)
    inside = both.withColumn("__in", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    ends = both.groupBy("__by", "__block").agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), F.col("__ts"))).alias("__end"))
    before = W.partitionBy("__by").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    got = inside.join(carry, ["__by", "__block"], "left").select("__l", F.coalesce("__in", "__carry").alias("__hit"))
    rest = lf.where(~usable).select("__l", F.lit(None).cast(r.schema["__r"].dataType).alias("__hit"))
    return got.unionAll(rest).select("__l.*", "__hit.*")


def interval_agg(
    left: DataFrame, right: DataFrame, key: str, by: str, left_ts: str, right_ts: str, start: int, end: int, aggs: list[Column],
) -> DataFrame:
    """(key, aggs) over the right rows of the entity in [left_ts + start, left_ts + end] seconds, both inclusive.

    Left rows go to the one or two time buckets their interval touches, so the
    range join is an equi-join on (entity, bucket) with map-side filters.
    Left rows with an empty interval are left out.
    """
    width = max(1, end - start)
    bucket = lambda c: F.floor(c / width).cast("bigint")
    t = seconds(F.col(left_ts))
    lf = left.where(F.col(by).isNotNull() & F.col(left_ts).isNotNull()).select(
        F.col(key), F.col(by).alias("__by"), t.alias("__t"), F.explode(F.sequence(bucket(t + start), bucket(t + end))).alias("__bucket"))
    right = right.select(*[c for c in right.columns if c != key])
    r = right.where(F.col(right_ts).isNotNull()).withColumn("__s", seconds(F.col(right_ts))).withColumn("__bucket", bucket(F.col("__s"))).withColumnRenamed(by, "__by")
    j = lf.join(r, ["__by", "__bucket"]).where((F.col("__s") >= F.col("__t") + start) & (F.col("__s") <= F.col("__t") + end))
    return j.groupBy(key).agg(*aggs)


def prices_at(events: DataFrame, bars: DataFrame, key: str, by: str, ts: str, minutes: list[int]) -> DataFrame:
    """(key, by, ts, one struct (close, asof_ts) a shift): as-of prices at ts + each of ``minutes``, named p0, p15, m120 for -120.

    All times are looked up in one as-of, so the bars are shuffled and sorted
    once whatever the number of shifts. ``key`` is unique.
    """
    e = events.select(key, by, ts, F.explode(F.array(*map(F.lit, minutes))).alias("__shift"))
    e = e.withColumn("__at", F.col(ts) + F.make_dt_interval(mins=F.col("__shift")))
    a = asof(e, bars.select(by, "ts_utc", "close"), by, "__at", "ts_utc", ["close"])
    name = lambda m: f"p{m}" if m >= 0 else f"m{-m}"
    return a.groupBy(key, by, ts).agg(*[F.max(F.when(F.col("__shift") == m, F.struct("close", "asof_ts"))).alias(name(m)) for m in minutes])


def change(later: Column, earlier: Column) -> Column:
    """(later - earlier) / earlier; null where there is nothing to divide by."""
    return (later - earlier) / F.nullif(earlier, F.lit(0.0))


def impacts(events: DataFrame, bars: DataFrame, key: str, by: str, ts: str, windows: list[int], before: int | None = None) -> DataFrame:
    """(key, by, window_min, price_event, price_future, delta, ret, event_gap_s, future_gap_s): as-of prices at ts and ts + window.

    With ``before`` also pre_ret: the change to price_event from the as-of price so many minutes earlier.
    """
    p = prices_at(events, bars, key, by, ts, [0, *windows, *([-before] if before else [])])
    gap = lambda a, b: F.abs(seconds(a) - seconds(b))
    at = F.array(*[F.struct(F.lit(w).alias("window_min"), F.col(f"p{w}").alias("f")) for w in windows])
    f = p.withColumn("__w", F.explode(at))
    now, then = F.col("p0.close"), F.col("__w.f.close")
    w = F.col("__w.window_min")
    extra = [change(now, F.col(f"m{before}.close")).alias("pre_ret")] if before else []
    return f.select(
        key, by, w.alias("window_min"), now.alias("price_event"), then.alias("price_future"), (then - now).alias("delta"),
        change(then, now).alias("ret"), gap(F.col(ts), F.col("p0.asof_ts")).alias("event_gap_s"),
        gap(F.col(ts) + F.make_dt_interval(mins=w), F.col("__w.f.asof_ts")).alias("future_gap_s"), *extra)


def fresh(df: DataFrame, seconds_: int = 300) -> DataFrame:
    """Stale filter: both gaps at most so many seconds; null gaps are dropped."""
    return df.where((F.col("event_gap_s") <= seconds_) & (F.col("future_gap_s") <= seconds_))
