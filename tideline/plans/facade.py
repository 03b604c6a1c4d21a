"""Answers as nested rows: an event in its market context, and a question routed.

Model scores, encoders and summaries are injected as functions of columns; the
defaults need no network.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import labels, retrieval, temporal

Scorer = Callable[[Column], Column]


def keyword_scores(text: Column) -> Column:
    """Array of three scores (down, flat, up) from the words of either direction."""
    d = T.direction(text)
    return F.array(F.when(d == "bearish", 1.0).otherwise(0.0), F.when(d == "neutral", 1.0).otherwise(0.0), F.when(d == "bullish", 1.0).otherwise(0.0))


def analyse_events(events: DataFrame, bars: DataFrame, key: str, by: str, ts: str, text: str, scorer: Scorer = keyword_scores) -> DataFrame:
    """(key, context, sentiment): the 120 minutes before each event and the scored label."""
    c = temporal.interval_agg(events, bars, key, by, ts, "ts_utc", -7200, 0, [
        F.min_by("open", F.col("__s")).alias("a"), F.max_by("close", F.col("__s")).alias("z"), F.max("high").alias("h"), F.min("low").alias("l"), F.count("*").alias("n")])
    ret, vol = (F.col("z") - F.col("a")) / F.col("a"), (F.col("h") - F.col("l")) / F.col("a")
    c = c.where("n >= 2").select(key, F.struct(F.col("n").alias("bars"), ret.alias("pre_ret"), vol.alias("volatility"), labels.trend(ret, vol, "serve").alias("trend_tag")).alias("context"))
    p = labels.softmax(scorer(F.col(text)))
    best = F.array_max(p)
    s = events.select(key, F.struct((F.array_position(p, best) - 2).cast("int").alias("label"), best.alias("confidence")).alias("sentiment"))
    return s.join(c, key, "left").select(key, "context", "sentiment")


def search(queries: DataFrame, chunks: DataFrame, k: int = 5, where: Column | None = None) -> DataFrame:
    """(query_id, citations): the k nearest chunks as an array in order of rank; a filter holds before the ranking."""
    c = chunks.where(where) if where is not None else chunks
    hits = retrieval.nearest(queries, c.select("id", "vector"), k).join(c.select("id", "text"), "id")
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", F.left("text", F.lit(100)).alias("snippet")))).alias("citations"))


def route(questions: DataFrame, text: str) -> DataFrame:
    return questions.withColumn("route", T.query_route(F.col(text)))
