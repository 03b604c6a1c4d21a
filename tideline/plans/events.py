"""Event-study, relational and label queries, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import labels, metrics, temporal
from tideline.operators.ranks import positions
from tideline.session import cut, table

WINDOWS = [5, 10, 15, 30]
SPLIT = ("2025-08-01", "2025-11-01", "2026-02-01")


def _bars(s: SparkSession, d: str) -> DataFrame:
    return temporal.clean_bars(table(s, d, "prices_m1"))


def _news(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_items").withColumn("ts_utc", F.col("ts") - F.expr("INTERVAL 8 HOURS"))


def _set(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bert_finetune_cls")


def s1_price_scan(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "prices_m1").where("ticker = 'XAUUSD' and ts_utc is not null")
    return p.select("bar_id", "ts_utc", F.when(~F.isnan("close"), F.col("close")).alias("close"), "volume")


def s2_event_scan(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_items").select("news_id", "ts", "source", "event_id", "country", "name", "content", "star", "previous", "consensus", "actual").orderBy("ts", "news_id")


def _impacts(s: SparkSession, d: str, windows: list[int] = WINDOWS, ticker: str | None = None, before: int | None = None) -> DataFrame:
    """A ticker is filtered in both scans: the joins never see the others."""
    one = F.lit(True) if ticker is None else F.col("ticker") == ticker
    return temporal.impacts(_news(s, d).where(one), temporal.clean_bars(table(s, d, "prices_m1").where(one)), "news_id", "ticker", "ts_utc", windows, before)


def s3_impact_scan(s: SparkSession, d: str) -> DataFrame:
    return _impacts(s, d, [15], "XAUUSD").select("news_id", F.round("ret", 9).alias("ret_post"))


def s4_price_range(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "prices_m1").where("ticker = 'XAUUSD' and ts_utc >= timestamp_ntz'2025-10-06 00:00:00' and ts_utc < timestamp_ntz'2025-10-08 00:00:00'")
    return p.select("bar_id", "ts_utc", "open", "high", "low")


def s12_json_fields(s: SparkSession, d: str) -> DataFrame:
    x = F.from_json("extra", "channel int, hot string")
    return table(s, d, "news_items").where("extra is not null").select("news_id", x["channel"].alias("channel"), x["hot"].alias("hot"))


def f3_fresh_impacts(s: SparkSession, d: str) -> DataFrame:
    return temporal.fresh(_impacts(s, d)).groupBy("window_min").agg(F.count("*").alias("n"))


def f4_clip(s: SparkSession, d: str) -> DataFrame:
    return _set(s, d).select("rec_id", labels.clip(F.col("ret_post"), 0.0005).alias("ret_post"), labels.clip(F.col("pre_ret"), 0.0005).alias("pre_ret"))


def f5_time_split(s: SparkSession, d: str) -> DataFrame:
    d_ = _set(s, d).withColumn("part", labels.time_split(F.col("event_ts_local"), *SPLIT)).where("part is not null")
    return d_.groupBy("part").agg(F.count("*").alias("n"))


def f6_high_confidence(s: SparkSession, d: str) -> DataFrame:
    x = _set(s, d)
    t = labels.quantiles(x.where("split = 'train'"), {
        "q15": (F.col("ret_post"), 0.15, -0.001), "q85": (F.col("ret_post"), 0.85, 0.001), "q25": (F.abs("ret_post"), 0.25, 0.001)})
    keep = ((F.col("label") == -1) & (F.col("ret_post") < F.col("q15"))) | ((F.col("label") == 0) & (F.abs("ret_post") < F.col("q25"))) | ((F.col("label") == 1) & (F.col("ret_post") > F.col("q85")))
    return labels.with_thresholds(x, t).where(keep).select("rec_id", "split", "label")


def f7_event_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_items").where("source like '%flash%' or (source like '%calendar%' and star >= 3)").select("news_id", "source", "star")


def f8_significant(s: SparkSession, d: str) -> DataFrame:
    i = _impacts(s, d, [15]).where("abs(ret) > 0.0005").select("news_id", F.round("ret", 9).alias("ret"))
    return table(s, d, "news_items").where("content is not null and length(content) > 20").select("news_id").join(i, "news_id")


def f9_published(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "flash").where("actual is not null and actual <> '未公布' and indicator_name is not null").select("row_id", "actual")


def f10_reversal(s: SparkSession, d: str) -> DataFrame:
    p = _pivot(s, d)
    return p.where("abs(r5) > 0.002 and ((r5 > 0 and r15 < -0.0003) or (r5 < 0 and r15 > 0.0003))").select("news_id")


def f11_important(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "flash").select("row_id", "important", T.heat(F.col("hot")).alias("level")).where("important = 1 or level >= 2")


def f17_head(s: SparkSession, d: str) -> DataFrame:
    return _set(s, d).where("split = 'train'").orderBy("event_ts_local", "rec_id").limit(800).select("rec_id")


def j1_events_impacts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "news_items").select("news_id", "source", "country")
    i = _impacts(s, d, [30]).select("news_id", F.round("ret", 9).alias("ret"))
    return e.join(i, "news_id")


def _pivot(s: SparkSession, d: str) -> DataFrame:
    i = _impacts(s, d)
    at = lambda w: F.max(F.when(F.col("window_min") == w, F.col("ret")))
    return i.groupBy("news_id").agg(at(5).alias("r5"), at(15).alias("r15"), at(30).alias("r30"))


def j2_window_pivot(s: SparkSession, d: str) -> DataFrame:
    p = _pivot(s, d).where("r5 is not null and r15 is not null and r30 is not null")
    return p.select("news_id", *[F.round(c, 9).alias(c) for c in ("r5", "r15", "r30")])


def j3_left_default(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "news_items").where("source like '%calendar%'").select("news_id")
    i = _impacts(s, d, [15]).select("news_id", "ret")
    return e.join(i, "news_id", "left").select("news_id", F.round(F.coalesce("ret", F.lit(0.0)), 9).alias("ret"))


def j6_asof(s: SparkSession, d: str) -> DataFrame:
    return temporal.asof(_news(s, d).select("news_id", "ticker", "ts_utc"), _bars(s, d).select("ticker", F.col("ts_utc").alias("bar_ts"), "close"), "ticker", "ts_utc", "bar_ts", ["close"]).select("news_id", "asof_ts", "close")


def j7_impacts(s: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 9).alias(c)
    return _impacts(s, d).select("news_id", "window_min", "price_event", "price_future", r("delta"), r("ret"))


def j8_forward_range(s: SparkSession, d: str) -> DataFrame:
    return temporal.interval_agg(_news(s, d), _bars(s, d), "news_id", "ticker", "ts_utc", "ts_utc", 0, 900, [
        F.max("high").alias("high"), F.min("low").alias("low"), F.count("*").alias("bars")])


def m2_backward_return(s: SparkSession, d: str) -> DataFrame:
    """Change to the event's price from the as-of price 120 minutes before, clipped; not the first bar of the window, which is `a1_lookback`."""
    i = _impacts(s, d, [15], before=120).where("price_event is not null")
    return i.select("news_id", F.round(labels.clip(F.col("pre_ret"), 0.05), 9).alias("pre_ret"))


def m3_range_ratio(s: SparkSession, d: str) -> DataFrame:
    """(high - low of the 15 minutes from the event on) / price at the event."""
    h = temporal.interval_agg(_news(s, d), _bars(s, d), "news_id", "ticker", "ts_utc", "ts_utc", 0, 900, [F.max("high").alias("high"), F.min("low").alias("low")])
    p = temporal.prices_at(_news(s, d), _bars(s, d), "news_id", "ticker", "ts_utc", [0]).select("news_id", F.col("p0.close").alias("p"))
    return p.join(h, "news_id", "left").select("news_id", F.round((F.col("high") - F.col("low")) / F.nullif("p", F.lit(0.0)), 9).alias("range_ratio"))


def a1_lookback(s: SparkSession, d: str) -> DataFrame:
    closes = F.col("close").isNotNull()
    d_ = temporal.interval_agg(_news(s, d), _bars(s, d), "news_id", "ticker", "ts_utc", "ts_utc", -7200, 0, [
        F.min_by("open", F.col("__s")).alias("price_start"), F.max_by("close", F.when(closes, F.col("__s"))).alias("price_end"),
        F.max("high").alias("price_high"), F.min("low").alias("price_low"), F.count("*").alias("bars")])
    d_ = d_.where("bars >= 2")
    ret = (F.col("price_end") - F.col("price_start")) / F.col("price_start")
    vol = (F.col("price_high") - F.col("price_low")) / F.col("price_start")
    return d_.select("news_id", "bars", F.round(ret, 9).alias("pre_ret"), F.round(vol, 9).alias("volatility"), labels.trend(ret, vol, "context").alias("trend_tag"))


def j10_plot_price(s: SparkSession, d: str) -> DataFrame:
    """Where an event is drawn: a little off its fresh price, else at the low, high or close of the last bar, else at the first close there is."""
    n = _news(s, d).select("news_id", "ticker", "ts_utc", T.direction(F.col("content")).alias("mood"))
    b = _bars(s, d).select("ticker", F.col("ts_utc").alias("bar_ts"), "high", "low", "close")
    a = temporal.asof(n, b, "ticker", "ts_utc", "bar_ts", ["high", "low", "close"])
    first = b.where("close is not null").groupBy("ticker").agg(F.min_by("close", "bar_ts").alias("first"))
    a = a.join(first, "ticker", "left")
    fresh = F.when(temporal.seconds(F.col("ts_utc")) - temporal.seconds(F.col("asof_ts")) <= 300, F.col("close"))
    up, down = F.col("mood") == "bullish", F.col("mood") == "bearish"
    near = F.when(up, F.col("low")).when(down, F.col("high")).otherwise(F.col("close"))
    shown = F.when(fresh.isNotNull(), fresh * F.when(up, 0.998).when(down, 1.002).otherwise(1.0)).when(F.col("asof_ts").isNotNull(), near).otherwise(F.col("first"))
    return a.select("news_id", "mood", F.round(shown, 6).alias("price"))


def j13_split_overlap(s: SparkSession, d: str) -> DataFrame:
    e = _set(s, d).where("event_id is not null").select("split", "event_id").distinct()
    a = e.groupBy("event_id").agg(*[F.max((F.col("split") == x).cast("int")).alias(x) for x in ("train", "val", "test")])
    return a.agg(*[F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0)).alias(f"{x}_{y}") for x, y in (("train", "val"), ("train", "test"), ("val", "test"))])


def j14_coverage(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "market_context").where("event_id is not null").select("event_id")
    e = _set(s, d).where("event_id is not null").select("event_id").distinct()
    hit = e.join(c, "event_id", "left_semi").agg(F.count("*").alias("covered"))
    return e.agg(F.count("*").alias("events")).crossJoin(F.broadcast(hit))


def a2_quantiles(s: SparkSession, d: str) -> DataFrame:
    t = labels.quantiles(_set(s, d).where("split = 'train'"), {"q30": (F.col("ret_post"), 0.3, -0.001), "q70": (F.col("ret_post"), 0.7, 0.001)})
    return t.select(F.round("q30", 9).alias("q30"), F.round("q70", 9).alias("q70"))


def a4_label_split(s: SparkSession, d: str) -> DataFrame:
    return _set(s, d).groupBy("split").agg(*[F.count_if(F.col("label") == x).alias(n) for x, n in ((-1, "bearish"), (0, "neutral"), (1, "bullish"))], F.count("*").alias("n"))


def a5_value_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_items").groupBy("source", "country").agg(F.count("*").alias("n"))


def a6_top_other(s: SparkSession, d: str) -> DataFrame:
    return metrics.top_and_other(table(s, d, "news_items"), "country")


def a7_describe(s: SparkSession, d: str) -> DataFrame:
    x = _set(s, d).select("source", "label", "ret_post")
    one = x.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("up"),
        F.round(F.stddev_samp("ret_post"), 9).alias("sd"), F.round(F.avg((F.abs("ret_post") < 0.0002).cast("int")), 9).alias("near_zero"))
    m = labels.medians(x, "source", "ret_post").withColumnRenamed("source", "of")
    return one.join(m, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "n", "up", F.round("median", 9).alias("median"), "sd", "near_zero")


def a8_by_label(s: SparkSession, d: str) -> DataFrame:
    return _set(s, d).groupBy("label").agg(F.round(F.avg("ret_post"), 9).alias("mean"), F.round(F.stddev_samp("ret_post"), 9).alias("sd"), F.count("*").alias("n"))


def _predicted(s: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("pre_ret") > 0.001, 1).when(F.col("pre_ret") < -0.001, -1).otherwise(0)
    return _set(s, d).where("label is not null").select("rec_id", "split", "label", p.alias("pred"))


def a9_confusion(s: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_predicted(s, d), "label", "pred")


def a10_per_class(s: SparkSession, d: str) -> DataFrame:
    return metrics.per_class(_predicted(s, d), "label", "pred")


def a11_summary(s: SparkSession, d: str) -> DataFrame:
    return metrics.summary(_predicted(s, d), "label", "pred")


def a12_mean_std(s: SparkSession, d: str) -> DataFrame:
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(s, d, "citations").groupBy("page_idx").agg(r(F.avg("score"), "mean"), r(F.stddev_samp("score"), "sd"), r(F.stddev_pop("score"), "sd_pop"))


def a13_subgroup_mean(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "citations").agg(
        F.round(F.avg("score"), 6).alias("every"), F.round(F.avg(F.when(F.col("source_file").isNotNull(), F.col("score"))), 6).alias("sourced"))


def a14_relative(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "citations").groupBy("page_idx").agg(F.avg("score").alias("m"))
    base = F.broadcast(m.where("page_idx = 0").select(F.col("m").alias("b")))
    return m.crossJoin(base).select("page_idx", F.round((F.col("m") - F.col("b")) / F.col("b") * 100, 4).alias("change"))


def a15_bounds(s: SparkSession, d: str) -> DataFrame:
    span = lambda t, c, n: table(s, d, t).agg(F.lit(n).alias("of"), F.min(c).alias("first"), F.max(c).alias("last"))
    return span("prices_m1", "ts_utc", "prices").unionAll(span("news_items", "ts", "events"))


def a17_prefix_histogram(s: SparkSession, d: str) -> DataFrame:
    p = F.regexp_extract(f15_text(), r"^\[([^\]]+)\]", 1)
    return _set(s, d).groupBy(p.alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(10)


def a18_duplicates(s: SparkSession, d: str) -> DataFrame:
    return _set(s, d).groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.min("event_ts_local").alias("first"), F.max("event_ts_local").alias("last"))


def a20_corpus(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy("doc_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.col("source").isNull()).alias("no_source"), F.sum("n_chars").alias("chars"))


def a21_class_weights(s: SparkSession, d: str) -> DataFrame:
    return metrics.class_weights(_set(s, d).where("split = 'train'"), "label")


def a23_histogram(s: SparkSession, d: str) -> DataFrame:
    b = F.floor((labels.clip(F.col("ret_post"), 0.006) + 0.006) / 0.0002)
    return _set(s, d).where("ret_post is not null and not isnan(ret_post)").groupBy(F.least(b, F.lit(59)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def f15_text():
    """[SRC=..] [STAR=..] [IMP=..] [CTRY=..] before the text."""
    v = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(F.lit("[SRC="), v("source"), F.lit("] [STAR="), v("star"), F.lit("] [IMP="), v("important"), F.lit("] [CTRY="), v("country"), F.lit("] "), v("text"))


def f15_prefix(s: SparkSession, d: str) -> DataFrame:
    return _set(s, d).select("rec_id", f15_text().alias("text"))


def f16_recode(s: SparkSession, d: str) -> DataFrame:
    return _set(s, d).where("label is not null").groupBy((F.col("label") + 1).alias("class_id")).agg(F.count("*").alias("n"))


def m4_numbers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "flash").select("row_id", *[labels.number(F.col(c)).alias(c) for c in ("previous", "consensus", "actual")])


def m5_surprise(s: SparkSession, d: str) -> DataFrame:
    gap = labels.number(F.col("actual")) - labels.number(F.col("consensus"))
    return _set(s, d).select("rec_id", F.round(gap, 6).alias("surprise"), labels.sign(gap).alias("sign"))


def m9_six_classes(s: SparkSession, d: str) -> DataFrame:
    x = _set(s, d).withColumn("fs", labels.sign(labels.number(F.col("actual")) - labels.number(F.col("consensus"))))
    t = labels.quantiles(x.where("split = 'train'"), {
        "ql": (F.col("ret_post"), 0.3, -0.001), "qh": (F.col("ret_post"), 0.7, 0.001), "pre_min": (F.abs("pre_ret"), 0.8, 0.0),
        "post_min": (F.abs("ret_post"), 0.7, 0.0), "range_min": (F.col("range_ratio"), 0.85, 0.0), "abs_max": (F.abs("ret_post"), 0.2, 0.0)})
    y = labels.with_thresholds(x, t)
    c = F.col
    y = y.withColumns({
        "base": labels.three_class(c("ret_post"), c("ql"), c("qh")),
        "priced": labels.priced_in(c("fs"), c("pre_ret"), c("ret_post"), c("pre_min"), c("post_min")),
        "watch": labels.watch(c("range_ratio"), F.abs("ret_post"), c("range_min"), c("abs_max"))})
    return y.select("rec_id", "base", "priced", "watch", labels.six_class(c("base"), c("priced"), c("watch")).alias("class_id"))


def m10_trends(s: SparkSession, d: str) -> DataFrame:
    return _set(s, d).select("rec_id", *[labels.trend(F.col("pre_ret"), F.col("range_ratio"), p).alias(p) for p in labels.TREND])


def w1_range_frame(s: SparkSession, d: str) -> DataFrame:
    """The same frame as a RANGE window, for every bar; partitioned by entity and day with the day before repeated."""
    b = _bars(s, d).select("ticker", "ts_utc", "close")
    day = F.floor(temporal.seconds(F.col("ts_utc")) / 86400).cast("bigint")
    b = b.select("*", day.alias("day"), F.explode(F.array_distinct(F.array(day, F.floor((temporal.seconds(F.col("ts_utc")) + 7200) / 86400).cast("bigint")))).alias("part"))
    frame = """max(close) OVER w AS high, count(close) OVER w AS n FROM {b}
      WINDOW w AS (PARTITION BY ticker, part ORDER BY ts_utc RANGE BETWEEN INTERVAL 120 MINUTES PRECEDING AND CURRENT ROW)"""
    return s.sql(f"SELECT ticker, ts_utc, high, n FROM (SELECT ticker, ts_utc, day, part, {frame}) WHERE day = part", b=b)


def t3_seeded_order(s: SparkSession, d: str) -> DataFrame:
    """All rows in a seeded order, with their positions: sorted as ranges, numbered from the counts of the ranges."""
    h = F.md5(F.concat(F.col("rec_id").cast("string"), F.lit("|7"))).alias("h")
    return positions(_set(s, d).select("rec_id", h), ["h", "rec_id"]).select("rec_id", "position")


def t4_tail(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "prices_m1").where("ticker = 'XAUUSD'").orderBy(F.desc("ts_utc"), F.desc("bar_id")).limit(1000).select("bar_id", "ts_utc")


#: Shares of the seven kinds in hundredths, and the sample they are slices of; the first four top up.
QUOTAS = {"sentiment": (20, "flash"), "json_news": (12, "flash"), "multi_window": (15, "flash"), "risk": (13, "flash"), "calendar": (18, "calendar"), "calendar_json": (10, "calendar"), "priced_in": (12, "priced_in")}


def t5_quotas(s: SparkSession, d: str, target: int = 500) -> DataFrame:
    """(news_id, kind): slices of three seeded samples in exact shares; what is short of the target is topped up in turn from the rest of the first."""
    n = table(s, d, "news_items").select("news_id", "source", F.md5(F.concat(F.col("news_id").cast("string"), F.lit("|7"))).alias("h"))
    back = f10_reversal(s, d)
    sample = {"flash": n.where("source like '%flash%'"), "calendar": n.where("source like '%calendar%'"), "priced_in": n.join(back, "news_id", "left_semi")}
    # at most ``target`` rows of each sample are ordered: a top-k
    first = {k: x.orderBy("h", "news_id").limit(target).withColumn("i", F.row_number().over(W.orderBy("h", "news_id")) - 1) for k, x in sample.items()}
    begin, out, topped = {}, [], [k for k, (_, x) in QUOTAS.items() if x == "flash"]
    for kind, (share, of) in QUOTAS.items():
        lo = begin.get(of, 0)
        begin[of] = lo + target * share // 100
        out.append(first[of].where((F.col("i") >= lo) & (F.col("i") < begin[of])).select("news_id", F.lit(kind).alias("kind")))
    got = reduce(DataFrame.unionAll, out)
    short = got.agg((target - F.count("*")).alias("short"))
    rest = first["flash"].where(F.col("i") >= begin["flash"]).crossJoin(F.broadcast(short)).where(F.col("i") < begin["flash"] + F.col("short"))
    turn = F.element_at(F.array(*map(F.lit, topped)), ((F.col("i") - begin["flash"]) % len(topped) + 1).cast("int"))
    return got.unionAll(rest.select("news_id", turn.alias("kind")))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Events, as-of returns, look-back context, train-only quantiles, labels; counts a split and label."""
    e = temporal.fresh(_impacts(s, d, [15])).select("news_id", "ret")
    c = a1_lookback(s, d).select("news_id", "pre_ret", "trend_tag")
    x = _news(s, d).select("news_id", "ts").join(e, "news_id").join(c, "news_id", "left")
    # the thresholds and the labels both read these rows: they are joined once
    x = cut(x.select("ret", "trend_tag", F.when(F.col("ts") < F.lit("2025-10-08").cast("timestamp_ntz"), "train").otherwise("test").alias("part")))
    t = labels.quantiles(x.where("part = 'train'"), {"ql": (F.col("ret"), 0.3, -0.001), "qh": (F.col("ret"), 0.7, 0.001)})
    y = labels.with_thresholds(x, t).withColumn("label", labels.three_class(F.col("ret"), F.col("ql"), F.col("qh")))
    return y.groupBy("part", "label", F.coalesce("trend_tag", F.lit("none")).alias("trend_tag")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    s1_price_scan, s2_event_scan, s3_impact_scan, s4_price_range, s12_json_fields, f3_fresh_impacts, f4_clip, f5_time_split, f6_high_confidence,
    f7_event_filter, f8_significant, f9_published, f10_reversal, f11_important, f15_prefix, f16_recode, f17_head, j1_events_impacts, j2_window_pivot,
    j3_left_default, j6_asof, j7_impacts, j8_forward_range, m2_backward_return, m3_range_ratio, a1_lookback, j10_plot_price, j13_split_overlap, j14_coverage, a2_quantiles, a4_label_split,
    a5_value_counts, a6_top_other, a7_describe, a8_by_label, a9_confusion, a10_per_class, a11_summary, a12_mean_std, a13_subgroup_mean, a14_relative,
    a15_bounds, a17_prefix_histogram, a18_duplicates, a20_corpus, a21_class_weights, a23_histogram, m4_numbers, m5_surprise, m9_six_classes, m10_trends,
    w1_range_frame, t3_seeded_order, t4_tail, t5_quotas, flagship)}

_N = "n AS (SELECT *, ts - INTERVAL 8 HOUR AS t FROM news_items)"
_B = """b AS (SELECT bar_id, ticker, ts_utc, CASE WHEN NOT isnan(open) THEN open END AS open, CASE WHEN NOT isnan(high) THEN high END AS high,
  CASE WHEN NOT isnan(low) THEN low END AS low, CASE WHEN NOT isnan(close) THEN close END AS close, volume FROM prices_m1
  WHERE ticker IS NOT NULL AND ts_utc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, ts_utc ORDER BY bar_id) = 1)"""
_I = f"""{_N}, {_B},
 e AS (SELECT n.news_id, n.ticker, n.t, b.close AS price_event, b.ts_utc AS event_bar FROM n ASOF LEFT JOIN b ON n.ticker = b.ticker AND n.t >= b.ts_utc),
 w AS (SELECT e.*, window_min, t + to_minutes(window_min) AS ft FROM e, (VALUES (5), (10), (15), (30)) v(window_min)),
 i AS (SELECT w.news_id, w.ticker, w.window_min, w.price_event, b.close AS price_future, b.close - w.price_event AS delta,
  (b.close - w.price_event) / nullif(w.price_event, 0) AS ret, abs(epoch_us(w.t) - epoch_us(w.event_bar)) / 1e6 AS event_gap_s,
  abs(epoch_us(w.ft) - epoch_us(b.ts_utc)) / 1e6 AS future_gap_s FROM w ASOF LEFT JOIN b ON w.ticker = b.ticker AND w.ft >= b.ts_utc)"""
_P = """p AS (SELECT news_id, max(ret) FILTER (window_min = 5) AS r5, max(ret) FILTER (window_min = 15) AS r15, max(ret) FILTER (window_min = 30) AS r30 FROM i GROUP BY news_id)"""
_NUM = """CASE WHEN lower(trim({c})) NOT IN ('', 'nan', 'none', 'null', '-', 'na') THEN (CASE WHEN NOT isnan(TRY_CAST(regexp_replace(trim({c}), '[%,​]', '', 'g') AS DOUBLE)) THEN TRY_CAST(regexp_replace(trim({c}), '[%,​]', '', 'g') AS DOUBLE) END) END"""
_T = "coalesce(CAST({c} AS VARCHAR), '')"
_F15 = f"'[SRC=' || {_T.format(c='source')} || '] [STAR=' || {_T.format(c='star')} || '] [IMP=' || {_T.format(c='important')} || '] [CTRY=' || {_T.format(c='country')} || '] ' || {_T.format(c='text')}"
_PRED = "q AS (SELECT rec_id, split, label, CASE WHEN pre_ret > 0.001 THEN 1 WHEN pre_ret < -0.001 THEN -1 ELSE 0 END AS pred FROM bert_finetune_cls WHERE label IS NOT NULL)"
_PC = f"""{_PRED}, k AS (SELECT CAST(label AS INTEGER) AS label FROM (VALUES (-1), (0), (1)) v(label)),
 c AS (SELECT k.label, (SELECT count(*) FROM q WHERE q.label = k.label AND q.pred = k.label) AS tp, (SELECT count(*) FROM q WHERE q.pred = k.label) AS np, (SELECT count(*) FROM q WHERE q.label = k.label) AS support FROM k),
 r AS (SELECT *, coalesce(tp / nullif(np, 0), 0.0) AS p, coalesce(tp / nullif(support, 0), 0.0) AS rc FROM c),
 m AS (SELECT label, round(p, 6) AS precision, round(rc, 6) AS recall, round(coalesce(2 * p * rc / nullif(p + rc, 0), 0.0), 6) AS f1, support FROM r)"""
_HITS = lambda ws: "(" + " + ".join(f"CAST(contains(lower(coalesce(content, '')), '{w}') AS INTEGER)" for w in ws) + ")"
_MOOD = f"CASE WHEN {_HITS(T.BULLISH)} > {_HITS(T.BEARISH)} THEN 'bullish' WHEN {_HITS(T.BEARISH)} > {_HITS(T.BULLISH)} THEN 'bearish' ELSE 'neutral' END"
_TREND = {
    "train": "CASE WHEN {p} IS NULL THEN 'Market Data Missing' WHEN {p} > 0.005 THEN 'Strong Rally' WHEN {p} < -0.005 THEN 'Sharp Decline' WHEN abs({p}) < 0.002 AND {v} > 0.008 THEN 'High Volatility' WHEN {p} > -0.005 AND {p} < -0.002 THEN 'Weak Decline' WHEN {p} > 0.002 AND {p} < 0.005 THEN 'Mild Rally' ELSE 'Sideways' END",
    "context": "CASE WHEN {p} IS NULL THEN 'Market Data Missing' WHEN {p} > 0.005 THEN 'Strong Rally' WHEN {p} < -0.005 THEN 'Sharp Decline' WHEN {v} > 0.008 THEN 'High Volatility' WHEN {p} > 0.001 THEN 'Mild Rally' WHEN {p} < -0.001 THEN 'Weak Decline' ELSE 'Sideways' END",
    "serve": "CASE WHEN {p} IS NULL THEN 'Market Data Missing' WHEN {p} > 0.01 THEN 'Strong Rally' WHEN {p} < -0.01 THEN 'Sharp Decline' WHEN {p} > 0.003 AND {p} <= 0.01 THEN 'Mild Rally' WHEN {p} >= -0.01 AND {p} < -0.003 THEN 'Weak Decline' WHEN abs({p}) < 0.003 AND {v} > 0.015 THEN 'High Volatility' ELSE 'Sideways' END",
}
_A1 = f"""l AS (SELECT n.news_id, count(*) AS bars, arg_min(b.open, b.ts_utc) AS o, arg_max(b.close, b.ts_utc) FILTER (b.close IS NOT NULL) AS c, max(b.high) AS h, min(b.low) AS lo
  FROM n JOIN b ON n.ticker = b.ticker AND b.ts_utc >= n.t - INTERVAL 120 MINUTE AND b.ts_utc <= n.t GROUP BY n.news_id HAVING count(*) >= 2),
 x AS (SELECT news_id, bars, (c - o) / o AS pr, (h - lo) / o AS vol FROM l),
 a1 AS (SELECT news_id, bars, round(pr, 9) AS pre_ret, round(vol, 9) AS volatility, {_TREND['context'].format(p='pr', v='coalesce(vol, 0)')} AS trend_tag FROM x)"""

SQL = {
    "s1_price_scan": "SELECT bar_id, ts_utc, CASE WHEN NOT isnan(close) THEN close END AS close, volume FROM prices_m1 WHERE ticker = 'XAUUSD' AND ts_utc IS NOT NULL",
    "s2_event_scan": "SELECT news_id, ts, source, event_id, country, name, content, star, previous, consensus, actual FROM news_items ORDER BY ts, news_id",
    "s3_impact_scan": f"WITH {_I} SELECT news_id, round(ret, 9) AS ret_post FROM i WHERE ticker = 'XAUUSD' AND window_min = 15",
    "s4_price_range": "SELECT bar_id, ts_utc, open, high, low FROM prices_m1 WHERE ticker = 'XAUUSD' AND ts_utc >= TIMESTAMP '2025-10-06' AND ts_utc < TIMESTAMP '2025-10-08'",
    "s12_json_fields": "SELECT news_id, CAST(json_extract_string(extra, '$.channel') AS INTEGER) AS channel, json_extract_string(extra, '$.hot') AS hot FROM news_items WHERE extra IS NOT NULL",
    "f3_fresh_impacts": f"WITH {_I} SELECT window_min, count(*) AS n FROM i WHERE event_gap_s <= 300 AND future_gap_s <= 300 GROUP BY window_min",
    "f4_clip": "SELECT rec_id, CASE WHEN ret_post IS NOT NULL THEN greatest(-0.0005, least(ret_post, 0.0005)) END AS ret_post, CASE WHEN pre_ret IS NOT NULL THEN greatest(-0.0005, least(pre_ret, 0.0005)) END AS pre_ret FROM bert_finetune_cls",
    "f5_time_split": "SELECT part, count(*) AS n FROM (SELECT CASE WHEN event_ts_local < TIMESTAMP '2025-08-01' THEN 'train' WHEN event_ts_local < TIMESTAMP '2025-11-01' THEN 'val' WHEN event_ts_local < TIMESTAMP '2026-02-01' THEN 'test' END AS part FROM bert_finetune_cls) WHERE part IS NOT NULL GROUP BY part",
    "f6_high_confidence": "WITH t AS (SELECT quantile_cont(ret_post, 0.15) AS q15, quantile_cont(ret_post, 0.85) AS q85, quantile_cont(abs(ret_post), 0.25) AS q25 FROM bert_finetune_cls WHERE split = 'train') SELECT rec_id, split, label FROM bert_finetune_cls, t WHERE (label = -1 AND ret_post < q15) OR (label = 0 AND abs(ret_post) < q25) OR (label = 1 AND ret_post > q85)",
    "f7_event_filter": "SELECT news_id, source, star FROM news_items WHERE source LIKE '%flash%' OR (source LIKE '%calendar%' AND star >= 3)",
    "f8_significant": f"WITH {_I} SELECT n.news_id, round(i.ret, 9) AS ret FROM n JOIN i USING (news_id) WHERE window_min = 15 AND abs(i.ret) > 0.0005 AND length(content) > 20",
    "f9_published": "SELECT row_id, actual FROM flash WHERE actual IS NOT NULL AND actual <> '未公布' AND indicator_name IS NOT NULL",
    "f10_reversal": f"WITH {_I}, {_P} SELECT news_id FROM p WHERE abs(r5) > 0.002 AND ((r5 > 0 AND r15 < -0.0003) OR (r5 < 0 AND r15 > 0.0003))",
    "f11_important": "SELECT * FROM (SELECT row_id, important, CASE trim(hot) WHEN '火' THEN 1 WHEN '热' THEN 2 WHEN '沸' THEN 3 WHEN '爆' THEN 4 END AS level FROM flash) WHERE important = 1 OR level >= 2",
    "f15_prefix": f"SELECT rec_id, {_F15} AS text FROM bert_finetune_cls",
    "f16_recode": "SELECT label + 1 AS class_id, count(*) AS n FROM bert_finetune_cls WHERE label IS NOT NULL GROUP BY 1",
    "f17_head": "SELECT rec_id FROM bert_finetune_cls WHERE split = 'train' ORDER BY event_ts_local NULLS FIRST, rec_id LIMIT 800",
    "j1_events_impacts": f"WITH {_I} SELECT n.news_id, n.source, n.country, round(i.ret, 9) AS ret FROM n JOIN i USING (news_id) WHERE window_min = 30",
    "j2_window_pivot": f"WITH {_I}, {_P} SELECT news_id, round(r5, 9) AS r5, round(r15, 9) AS r15, round(r30, 9) AS r30 FROM p WHERE r5 IS NOT NULL AND r15 IS NOT NULL AND r30 IS NOT NULL",
    "j3_left_default": f"WITH {_I} SELECT n.news_id, round(coalesce(i.ret, 0.0), 9) AS ret FROM n LEFT JOIN (SELECT * FROM i WHERE window_min = 15) i USING (news_id) WHERE source LIKE '%calendar%'",
    "j6_asof": f"WITH {_N}, {_B} SELECT n.news_id, b.ts_utc AS asof_ts, b.close FROM n ASOF LEFT JOIN b ON n.ticker = b.ticker AND n.t >= b.ts_utc",
    "j7_impacts": f"WITH {_I} SELECT news_id, window_min, price_event, price_future, round(delta, 9) AS delta, round(ret, 9) AS ret FROM i",
    "j8_forward_range": f"WITH {_N}, {_B} SELECT n.news_id, max(b.high) AS high, min(b.low) AS low, count(*) AS bars FROM n JOIN b ON n.ticker = b.ticker AND b.ts_utc >= n.t AND b.ts_utc <= n.t + INTERVAL 15 MINUTE GROUP BY n.news_id",
    "m2_backward_return": f"WITH {_I}, q AS (SELECT DISTINCT news_id, ticker, t - INTERVAL 120 MINUTE AS bt, price_event FROM w WHERE price_event IS NOT NULL) SELECT q.news_id, CASE WHEN b.close <> 0 THEN round(greatest(-0.05, least(0.05, (q.price_event - b.close) / b.close)), 9) END AS pre_ret FROM q ASOF LEFT JOIN b ON q.ticker = b.ticker AND q.bt >= b.ts_utc",
    "m3_range_ratio": f"WITH {_N}, {_B}, e AS (SELECT n.news_id, b.close AS p FROM n ASOF LEFT JOIN b ON n.ticker = b.ticker AND n.t >= b.ts_utc), h AS (SELECT n.news_id, max(b.high) AS hi, min(b.low) AS lo FROM n JOIN b ON n.ticker = b.ticker AND b.ts_utc >= n.t AND b.ts_utc <= n.t + INTERVAL 15 MINUTE GROUP BY n.news_id) SELECT news_id, round((hi - lo) / nullif(p, 0), 9) AS range_ratio FROM e LEFT JOIN h USING (news_id)",
    "a1_lookback": f"WITH {_N}, {_B}, {_A1} SELECT * FROM a1",
    "j10_plot_price": f"""WITH {_N}, {_B}, g AS (SELECT news_id, ticker, t, {_MOOD} AS mood FROM n), f AS (SELECT ticker, arg_min(close, ts_utc) AS first FROM b WHERE close IS NOT NULL GROUP BY ticker),
 a AS (SELECT g.*, b.high, b.low, b.close, b.ts_utc, CASE WHEN epoch_us(g.t) - epoch_us(b.ts_utc) <= 300000000 THEN b.close END AS fresh FROM g ASOF LEFT JOIN b ON g.ticker = b.ticker AND g.t >= b.ts_utc)
SELECT news_id, mood, round(CASE WHEN fresh IS NOT NULL THEN fresh * CASE mood WHEN 'bullish' THEN 0.998 WHEN 'bearish' THEN 1.002 ELSE 1.0::DOUBLE END
 WHEN ts_utc IS NOT NULL THEN CASE mood WHEN 'bullish' THEN low WHEN 'bearish' THEN high ELSE close END ELSE first END, 6) AS price FROM a LEFT JOIN f USING (ticker)""",
    "j13_split_overlap": "WITH a AS (SELECT event_id, max(CAST(split = 'train' AS INTEGER)) AS tr, max(CAST(split = 'val' AS INTEGER)) AS va, max(CAST(split = 'test' AS INTEGER)) AS te FROM bert_finetune_cls WHERE event_id IS NOT NULL GROUP BY event_id) SELECT CAST(sum(tr * va) AS BIGINT) AS train_val, CAST(sum(tr * te) AS BIGINT) AS train_test, CAST(sum(va * te) AS BIGINT) AS val_test FROM a",
    "j14_coverage": "WITH e AS (SELECT DISTINCT event_id FROM bert_finetune_cls WHERE event_id IS NOT NULL) SELECT count(*) AS events, count(*) FILTER (event_id IN (SELECT event_id FROM market_context WHERE event_id IS NOT NULL)) AS covered FROM e",
    "a2_quantiles": "SELECT round(quantile_cont(ret_post, 0.3), 9) AS q30, round(quantile_cont(ret_post, 0.7), 9) AS q70 FROM bert_finetune_cls WHERE split = 'train'",
    "a4_label_split": "SELECT split, count(*) FILTER (label = -1) AS bearish, count(*) FILTER (label = 0) AS neutral, count(*) FILTER (label = 1) AS bullish, count(*) AS n FROM bert_finetune_cls GROUP BY split",
    "a5_value_counts": "SELECT source, country, count(*) AS n FROM news_items GROUP BY source, country",
    "a6_top_other": "WITH c AS (SELECT country AS v, count(*) AS n FROM news_items GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v NULLS FIRST) AS k, count(*) OVER () AS kinds FROM c) SELECT CASE WHEN kinds > 5 AND k > 4 THEN 'Other' ELSE coalesce(v, '(null)') END AS category, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1",
    "a7_describe": "SELECT source, count(*) AS n, count(*) FILTER (label = 1) AS up, round(median(ret_post), 9) AS median, round(stddev_samp(ret_post), 9) AS sd, round(avg(CASE WHEN abs(ret_post) < 0.0002 THEN 1 WHEN ret_post IS NOT NULL THEN 0 END), 9) AS near_zero FROM bert_finetune_cls GROUP BY source",
    "a8_by_label": "SELECT label, round(avg(ret_post), 9) AS mean, round(stddev_samp(ret_post), 9) AS sd, count(*) AS n FROM bert_finetune_cls GROUP BY label",
    "a9_confusion": f"WITH {_PRED} SELECT label, count(*) FILTER (pred = -1) AS pred_m1, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM q GROUP BY label",
    "a10_per_class": f"WITH {_PC} SELECT * FROM m",
    "a11_summary": f"WITH {_PC} SELECT count(*) AS n, round(avg(CAST(label = pred AS INTEGER)), 6) AS accuracy, (SELECT round(avg(f1), 6) FROM m) AS macro_f1 FROM q",
    "a12_mean_std": "SELECT page_idx, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(stddev_pop(score), 6) AS sd_pop FROM citations GROUP BY page_idx",
    "a13_subgroup_mean": "SELECT round(avg(score), 6) AS every, round(avg(score) FILTER (source_file IS NOT NULL), 6) AS sourced FROM citations",
    "a14_relative": "WITH m AS (SELECT page_idx, avg(score) AS m FROM citations GROUP BY 1) SELECT m.page_idx, round((m.m - b.m) / b.m * 100, 4) AS change FROM m, (SELECT m FROM m WHERE page_idx = 0) b",
    "a15_bounds": "SELECT 'prices' AS of, min(ts_utc) AS first, max(ts_utc) AS last FROM prices_m1 UNION ALL SELECT 'events', min(ts), max(ts) FROM news_items",
    "a17_prefix_histogram": rf"SELECT regexp_extract({_F15}, '^\[([^\]]+)\]', 1) AS prefix, count(*) AS n FROM bert_finetune_cls GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10",
    "a18_duplicates": "SELECT split, count(*) AS n, count(DISTINCT event_id) AS ids, min(event_ts_local) AS first, max(event_ts_local) AS last FROM bert_finetune_cls GROUP BY split",
    "a20_corpus": "SELECT doc_type, count(*) AS n, count(*) FILTER (lang IS NULL) AS no_lang, count(*) FILTER (source IS NULL) AS no_source, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY doc_type",
    "a21_class_weights": "WITH t AS (SELECT label FROM bert_finetune_cls WHERE split = 'train' AND label IN (-1, 0, 1)) SELECT label, count(*) AS n, round((SELECT count(*) FROM t) / (3.0 * count(*)), 6) AS weight FROM t GROUP BY label",
    "a23_histogram": "SELECT CAST(least(floor((greatest(-0.006, least(ret_post, 0.006)) + 0.006) / CAST(0.0002 AS DOUBLE)), 59) AS INTEGER) AS bin, count(*) AS n FROM bert_finetune_cls WHERE ret_post IS NOT NULL AND NOT isnan(ret_post) GROUP BY 1",
    "m4_numbers": "SELECT row_id, " + ", ".join(f"{_NUM.format(c=c)} AS {c}" for c in ("previous", "consensus", "actual")) + " FROM flash",
    "m5_surprise": f"WITH x AS (SELECT rec_id, {_NUM.format(c='actual')} - {_NUM.format(c='consensus')} AS g FROM bert_finetune_cls) SELECT rec_id, round(g, 6) AS surprise, CAST(coalesce(sign(g), 0) AS INTEGER) AS sign FROM x",
    "m9_six_classes": f"""
WITH x AS (SELECT *, coalesce(sign({_NUM.format(c='actual')} - {_NUM.format(c='consensus')}), 0) AS fs FROM bert_finetune_cls),
 t AS (SELECT quantile_cont(ret_post, 0.3) AS ql, quantile_cont(ret_post, 0.7) AS qh, quantile_cont(abs(pre_ret), 0.8) AS pre_min, quantile_cont(abs(ret_post), 0.7) AS post_min,
  quantile_cont(range_ratio, 0.85) AS range_min, quantile_cont(abs(ret_post), 0.2) AS abs_max FROM x WHERE split = 'train'),
 y AS (SELECT rec_id, CASE WHEN ret_post IS NULL THEN 0 WHEN ret_post <= ql THEN -1 WHEN ret_post >= qh THEN 1 ELSE 0 END AS base,
  CASE WHEN abs(pre_ret) >= pre_min AND abs(ret_post) >= post_min AND fs > 0 AND pre_ret > 0 AND ret_post < 0 THEN 1
       WHEN abs(pre_ret) >= pre_min AND abs(ret_post) >= post_min AND fs < 0 AND pre_ret < 0 AND ret_post > 0 THEN -1 ELSE 0 END AS priced,
  CASE WHEN range_ratio >= range_min AND abs(ret_post) <= abs_max THEN 1 ELSE 0 END AS watch FROM x, t)
SELECT *, CASE WHEN watch = 1 THEN 5 WHEN priced = 1 THEN 3 WHEN priced = -1 THEN 4 WHEN base = 1 THEN 1 WHEN base = -1 THEN 2 ELSE 0 END AS class_id FROM y""",
    "m10_trends": "SELECT rec_id, " + ", ".join(f"{q.format(p='pre_ret', v='coalesce(range_ratio, 0)')} AS {k}" for k, q in _TREND.items()) + " FROM bert_finetune_cls",
    "w1_range_frame": f"WITH {_B} SELECT ticker, ts_utc, max(close) OVER w AS high, count(close) OVER w AS n FROM b WINDOW w AS (PARTITION BY ticker ORDER BY ts_utc RANGE BETWEEN INTERVAL 120 MINUTE PRECEDING AND CURRENT ROW)",
    "t3_seeded_order": "SELECT rec_id, row_number() OVER (ORDER BY md5(CAST(rec_id AS VARCHAR) || '|7'), rec_id) - 1 AS position FROM bert_finetune_cls",
    "t4_tail": "SELECT bar_id, ts_utc FROM prices_m1 WHERE ticker = 'XAUUSD' ORDER BY ts_utc DESC NULLS LAST, bar_id DESC LIMIT 1000",
    "t5_quotas": f"""WITH {_I}, {_P}, r AS (SELECT news_id FROM p WHERE abs(r5) > 0.002 AND ((r5 > 0 AND r15 < -0.0003) OR (r5 < 0 AND r15 > 0.0003))),
 h AS (SELECT news_id, source, md5(CAST(news_id AS VARCHAR) || '|7') AS h FROM news_items),
 f AS (SELECT news_id, row_number() OVER (ORDER BY h, news_id) - 1 AS k FROM h WHERE source LIKE '%flash%'),
 c AS (SELECT news_id, row_number() OVER (ORDER BY h, news_id) - 1 AS k FROM h WHERE source LIKE '%calendar%'),
 v AS (SELECT news_id, row_number() OVER (ORDER BY h, news_id) - 1 AS k FROM h WHERE news_id IN (SELECT news_id FROM r)),
 q AS (SELECT news_id, CASE WHEN k < 100 THEN 'sentiment' WHEN k < 160 THEN 'json_news' WHEN k < 235 THEN 'multi_window' ELSE 'risk' END AS kind FROM f WHERE k < 300
  UNION ALL SELECT news_id, CASE WHEN k < 90 THEN 'calendar' ELSE 'calendar_json' END FROM c WHERE k < 140 UNION ALL SELECT news_id, 'priced_in' FROM v WHERE k < 60)
SELECT * FROM q UNION ALL SELECT news_id, ['sentiment', 'json_news', 'multi_window', 'risk'][(k - 300) % 4 + 1] FROM f WHERE k >= 300 AND k < least(500, 300 + 500 - (SELECT count(*) FROM q))""",
    "flagship": f"""
WITH {_I}, {_A1},
 f AS (SELECT n.news_id, n.ts, i.ret, a1.trend_tag, CASE WHEN n.ts < TIMESTAMP '2025-10-08' THEN 'train' ELSE 'test' END AS part
  FROM n JOIN i ON n.news_id = i.news_id LEFT JOIN a1 ON n.news_id = a1.news_id WHERE window_min = 15 AND event_gap_s <= 300 AND future_gap_s <= 300),
 t AS (SELECT coalesce(quantile_cont(ret, 0.3), -0.001) AS ql, coalesce(quantile_cont(ret, 0.7), 0.001) AS qh FROM f WHERE part = 'train')
SELECT part, CASE WHEN ret IS NULL THEN 0 WHEN ret <= ql THEN -1 WHEN ret >= qh THEN 1 ELSE 0 END AS label, coalesce(trend_tag, 'none') AS trend_tag, count(*) AS n FROM f, t GROUP BY 1, 2, 3""",
}
