"""Batch twins of the streaming queries; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import table
from tideline.streaming import windows


def st_tumbling(s: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(s, d, "events"))


def st_sliding(s: SparkSession, d: str) -> DataFrame:
    return windows.sliding(table(s, d, "events"))


def st_sessions(s: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(s, d, "events"))


def st_ohlc(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars from ticks."""
    e = table(s, d, "events").where("event_type in ('view', 'click')")
    at = F.struct("ts", "event_id")
    g = e.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


QUERIES = {f.__name__: f for f in (st_tumbling, st_sliding, st_sessions, st_ohlc)}

SQL = {
    "st_tumbling": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "st_sliding": "WITH e AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS b FROM events), x AS (SELECT b AS start FROM e UNION ALL SELECT b - INTERVAL 5 MINUTE FROM e) SELECT start, count(*) AS n FROM x GROUP BY start",
    "st_sessions": "WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(h) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k",
    "st_ohlc": "SELECT user_id, date_trunc('hour', ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2",
}
