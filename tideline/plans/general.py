"""Queries of the delivery and instant operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import delivery, instants
from tideline.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    flash = delivery.surplus_messages(table(spark, d, "flash"))
    articles = delivery.surplus_articles(table(spark, d, "articles"))
    return flash.select(F.lit("flash").alias("src"), "row_key").unionAll(
        articles.select(F.lit("articles").alias("src"), "row_key"))


def p1_ranges(spark: SparkSession, d: str) -> DataFrame:
    return delivery.seen_ranges(table(spark, d, "flash"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    zones = table(spark, d, "source_zones")
    values = (
        instants.owned(table(spark, d, "flash"), "flash", "row_id", "time", None, zones)
        .unionAll(instants.owned(table(spark, d, "articles"), "articles", "id", "published_at", "site", zones))
        .unionAll(instants.owned(table(spark, d, "market_context"), "market_context", "context_id", "ts_end", "ticker", zones))
    )
    return instants.instants(values, "v", "zone", zones.select(F.col("tz").alias("zone"))).select("src", "row_key", "epoch_us")


QUERIES = {"p1_found": p1_found, "p1_ranges": p1_ranges, "p2_found": p2_found}

_KEY = r"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"
SQL = {
    "p1_found": f"""
WITH f AS (SELECT row_id, batch_id, {_KEY.format(c='id')} AS k FROM flash),
 a AS (SELECT id, created_at, {_KEY.format(c='site')} AS s, {_KEY.format(c='hash')} AS k FROM articles),
 fr AS (SELECT row_id, row_number() OVER (PARTITION BY k ORDER BY batch_id NULLS FIRST, row_id) AS n FROM f
        WHERE k NOT IN ('', 'nan', 'none', 'null')),
 ar AS (SELECT id, row_number() OVER (PARTITION BY s, k ORDER BY created_at NULLS FIRST, id) AS n FROM a
        WHERE k NOT IN ('', 'nan', 'none', 'null'))
SELECT 'flash' AS src, row_id AS row_key FROM fr WHERE n > 1
UNION ALL SELECT 'articles', id FROM ar WHERE n > 1""",
    "p1_ranges": f"""
WITH f AS (SELECT DISTINCT {_KEY.format(c='id')} AS k FROM flash),
 s AS (SELECT CAST(substr(k, 1, 8) AS BIGINT) AS producer, CAST(substr(k, 9) AS BIGINT) AS number FROM f
       WHERE regexp_full_match(k, '[0-9]{{23}}')),
 i AS (SELECT *, number - row_number() OVER (PARTITION BY producer ORDER BY number) AS g FROM s)
SELECT producer, min(number) AS lo, max(number) AS hi, max(number) - min(number) + 1 AS n FROM i GROUP BY producer, g""",
}
