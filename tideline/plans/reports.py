"""Searches by date, API responses, tables, label reports and word n-grams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import labels, metrics, retrieval
from tideline.plans import corpus as _c
from tideline.session import table
from tideline.sources.files import next_cursor, response_rows

RANGE = ("2025-03-01", "2025-09-30")


def _dated(s: SparkSession, d: str) -> DataFrame:
    """Vectors with the day of the document of the same number."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v.join(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_date").alias("day")), "id", "left")


def _in_range(s: SparkSession, d: str, post_filter: bool) -> DataFrame:
    v = _dated(s, d)
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return retrieval.in_range(q, v, 5, *RANGE, post_filter=post_filter).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def f14_vector_range(s: SparkSession, d: str) -> DataFrame:
    """The nearest vectors within a date range; the filter holds before the ranking."""
    return _in_range(s, d, False)


def f14_post_filter(s: SparkSession, d: str) -> DataFrame:
    """The same, filtered after three times as many were ranked: fewer may be left."""
    return _in_range(s, d, True)


def m21_stars(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_items").select("news_id", labels.stars(F.col("star")).alias("star"))


def a11_report(s: SparkSession, d: str) -> DataFrame:
    """Per label that was seen, and macro and weighted averages and the accuracy."""
    p = F.when(F.col("pre_ret") > 0.001, 1).when(F.col("pre_ret") < -0.001, -1).otherwise(0)
    return metrics.report(table(s, d, "bert_finetune_cls").where("label is not null and split = 'test'").select("label", p.alias("pred")), "label", "pred")


def x6_file_metadata(s: SparkSession, d: str) -> DataFrame:
    f = F.col("source_file")
    name = F.element_at(F.split(f, "/"), -1)
    return table(s, d, "citations").select("citation_id", T.file_source(name).alias("source"), T.file_language(name).alias("language"), T.file_date(name).alias("date"))


def s12_responses(s: SparkSession, d: str) -> DataFrame:
    """Each batch of messages as an API answers it, and read back: its rows, and the cursor of the next page."""
    f = table(s, d, "flash").where("id is not null and time is not null").select("batch_id", "row_id", "id", "time")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "id", "time"))), lambda r: F.struct(r["id"].alias("id"), r["time"].alias("time")))
    raw = f.groupBy("batch_id").agg(F.to_json(F.struct(F.struct(rows.alias("list")).alias("data"))).alias("raw"))
    got = response_rows(F.col("raw"), "id string, time string")
    return raw.select("batch_id", F.size(got).alias("n"), next_cursor(got).alias("c")).select("batch_id", "n", F.col("c.last_id").alias("last_id"), F.col("c.max_time").alias("max_time"))


def x9_described(s: SparkSession, d: str) -> DataFrame:
    """Which tables are simple enough for Markdown, and what is said of the others."""
    v = lambda c: F.col(c).cast("string")
    rows = F.array(F.array(F.lit("content"), F.lit("actual")), F.array(v("content"), v("actual")))
    return table(s, d, "flash").select("row_id", T.simple_table(rows).alias("simple"), T.described_table(rows).alias("said"))


def x19_words(s: SparkSession, d: str) -> DataFrame:
    """Word n-grams of one to three words."""
    g = table(s, d, "bert_finetune_cls").select(F.explode(T.word_ngrams(F.col("text"), 1, 3)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"))


def a20_languages(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select(T.language(F.col("text")).alias("language"), "text", (F.contains("text", F.lit("|"))).alias("has_table"))
    return x.groupBy("language").agg(F.count("*").alias("n"), F.count_if("has_table").alias("tables"), F.count_if(~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")).alias("empty"))


QUERIES = {f.__name__: f for f in (
    f14_vector_range, f14_post_filter, m21_stars, a11_report, x6_file_metadata, s12_responses, x9_described, x19_words, a20_languages)}

_NEAR = f"""
WITH v AS (SELECT vec_id AS id, embedding AS v, doc_date AS day FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
 x AS (SELECT q.id AS query_id, r.id, r.day, list_sum(list_transform(generate_series(1, 64), lambda i: pow(CAST(q.v[i] AS DOUBLE) - CAST(r.v[i] AS DOUBLE), 2))) AS dist FROM v q, v r WHERE q.id % 100 = 0 AND {{before}}),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS k FROM x),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM k WHERE k <= {{fetch}} AND day BETWEEN '{RANGE[0]}' AND '{RANGE[1]}')
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(1 / (1 + dist), 5) AS score FROM p WHERE rank <= 5"""
_NAME = "split_part(source_file, '/', -1)"
_DAY = _c.SQL["x6_file_dates"].removeprefix("WITH ").replace("source_file", _NAME)

SQL = {
    "f14_vector_range": _NEAR.format(before=f"r.day BETWEEN '{RANGE[0]}' AND '{RANGE[1]}'", fetch=5),
    "f14_post_filter": _NEAR.format(before="true", fetch=15),
    "m21_stars": "SELECT news_id, CAST(greatest(1, least(5, coalesce(star, 1))) AS INTEGER) AS star FROM news_items",
    "a11_report": """
WITH q AS (SELECT label, CASE WHEN pre_ret > 0.001 THEN 1 WHEN pre_ret < -0.001 THEN -1 ELSE 0 END AS pred FROM bert_finetune_cls WHERE label IS NOT NULL AND split = 'test'),
 k AS (SELECT DISTINCT unnest([label, pred]) AS label FROM q),
 c AS (SELECT k.label, (SELECT count(*) FROM q WHERE q.label = k.label AND q.pred = k.label) AS tp, (SELECT count(*) FROM q WHERE q.pred = k.label) AS np, (SELECT count(*) FROM q WHERE q.label = k.label) AS support FROM k),
 r AS (SELECT *, coalesce(tp / nullif(np, 0), 0.0) AS p, coalesce(tp / nullif(support, 0), 0.0) AS rc FROM c),
 m AS (SELECT label, p, rc, coalesce(2 * p * rc / nullif(p + rc, 0), 0.0) AS f, support, tp FROM r)
SELECT CAST(label AS VARCHAR) AS label, round(p, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(rc), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""",
    "x6_file_metadata": f"""
WITH f AS (WITH {_DAY}), n AS (SELECT citation_id, {_NAME} AS name FROM citations)
SELECT citation_id, CASE WHEN name IS NULL THEN NULL WHEN contains(name, 'Goldman') THEN 'Goldman Sachs' WHEN contains(name, 'J.P. Morgan') OR contains(name, 'J.P.Morgan') THEN 'J.P. Morgan' WHEN contains(name, 'Morgan Stanley') THEN 'Morgan Stanley' WHEN contains(name, 'UBS') THEN 'UBS' ELSE 'other' END AS source,
 CASE WHEN name IS NULL THEN NULL WHEN starts_with(name, 'H3_') OR starts_with(name, '4f20') THEN 'zh' ELSE 'en' END AS language, date FROM n JOIN f USING (citation_id)""",
    "s12_responses": "SELECT batch_id, CAST(count(*) AS INTEGER) AS n, arg_max(id, row_id) AS last_id, arg_max(time, row_id) AS max_time FROM flash WHERE id IS NOT NULL AND time IS NOT NULL GROUP BY batch_id",
    "x9_described": "SELECT row_id, (13 + coalesce(length(content), 0) + coalesce(length(actual), 0)) / (2.0 + CAST(coalesce(content, '') <> '' AS INTEGER) + CAST(coalesce(actual, '') <> '' AS INTEGER)) <= 50 AS simple, '2行×2列表格，包含content、actual' AS said FROM flash",
    "x19_words": r"""
WITH t AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM bert_finetune_cls), k AS (SELECT w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM t, (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n)
SELECT array_to_string(w[i : i + n - 1], ' ') AS gram, count(*) AS n FROM k GROUP BY 1""",
    "a20_languages": f"WITH l AS ({_c.SQL['x4_languages']}) SELECT language, count(*) AS n, count(*) FILTER (contains(text, '|')) AS tables, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '\\S')) AS empty FROM l JOIN documents USING (doc_id) GROUP BY language",
}
