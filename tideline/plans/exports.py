"""What sinks write: metadata, exports, reports and vectors, each as a query with its SQL."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import labels, predict, upsert
from tideline.plans import events as _e
from tideline.session import table


def k4_repeated_keys(s: SparkSession, d: str) -> DataFrame:
    """Keys that would break the unique index of an upserted table, with their number of rows."""
    a = table(s, d, "articles").select("url", "hash", "site", "source", "published_at")
    return a.groupBy(upsert.article_key().alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def k7_metadata(s: SparkSession, d: str) -> DataFrame:
    """Thresholds, sizes and label distribution of the splits in one row a split, as the metadata file holds them."""
    x = table(s, d, "bert_finetune_cls").select("split", "label", "ret_post")
    t = labels.quantiles(x.where("split = 'train'"), {"ql": (F.col("ret_post"), 0.3, -0.001), "qh": (F.col("ret_post"), 0.7, 0.001)})
    n = x.groupBy("split").agg(F.count("*").alias("size"), *[F.count_if(F.col("label") == v).alias(c) for v, c in ((-1, "down"), (0, "flat"), (1, "up"))])
    return labels.with_thresholds(n, t).select("split", "size", "down", "flat", "up", F.round("ql", 9).alias("ql"), F.round("qh", 9).alias("qh"))


def k8_export(s: SparkSession, d: str) -> DataFrame:
    """Events joined with their impacts; the writer sorts inside the files, `ranks.positions` where one order is asked for."""
    e = table(s, d, "news_items").select("news_id", "ts", "source", "country", "star")
    return e.join(_e._impacts(s, d).select("news_id", "window_min", F.round("ret", 9).alias("ret")), "news_id")


def k11_predictions(s: SparkSession, d: str) -> DataFrame:
    """Rows of a prediction file: event, label, prediction."""
    return _e._predicted(s, d).where("split = 'test'").select("rec_id", "label", "pred")


_CLASSES = ("[a-zA-Z]", "[0-9]", "[一-鿿]")


def _counter() -> predict.Predictor:
    """A model small enough for a test: numbers of letters, digits and Chinese characters."""
    found = [re.compile(c) for c in _CLASSES]
    return lambda texts: np.array([[len(f.findall(t)) for f in found] for t in texts], np.float64)


def l5_encoded(s: SparkSession, d: str) -> DataFrame:
    """Texts through an injected encoder in batches."""
    x = predict.predicted(table(s, d, "bert_finetune_cls"), "rec_id", "text", _counter, "vector")
    return x.select("rec_id", *[F.get("vector", F.lit(i)).alias(n) for i, n in enumerate(("letters", "digits", "han"))])


def l4_scored(s: SparkSession, d: str) -> DataFrame:
    """Class and confidence from an injected scorer in batches."""
    x = predict.predicted(table(s, d, "bert_finetune_cls").where("text is not null"), "rec_id", "text", _counter)
    p = labels.softmax(F.transform("scores", lambda v: v / 10))
    return x.select("rec_id", (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("class_id"), F.round(F.array_max(p), 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (k4_repeated_keys, k7_metadata, k8_export, k11_predictions, l5_encoded, l4_scored)}

_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(text, '{c}')) AS DOUBLE)" for c in _CLASSES)

SQL = {
    "k4_repeated_keys": "WITH k AS (SELECT CASE WHEN nullif(trim(url), '') IS NOT NULL THEN 'u|' || url ELSE 'h|' || coalesce(hash, '') || '|' || coalesce(site, '') || '|' || coalesce(source, '') || '|' || coalesce(published_at, '') END AS key FROM articles) SELECT key, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1",
    "k7_metadata": "WITH t AS (SELECT quantile_cont(ret_post, 0.3) AS ql, quantile_cont(ret_post, 0.7) AS qh FROM bert_finetune_cls WHERE split = 'train') SELECT split, count(*) AS size, count(*) FILTER (label = -1) AS down, count(*) FILTER (label = 0) AS flat, count(*) FILTER (label = 1) AS up, round(any_value(ql), 9) AS ql, round(any_value(qh), 9) AS qh FROM bert_finetune_cls, t GROUP BY split",
    "k8_export": f"WITH {_e._I} SELECT n.news_id, n.ts, n.source, n.country, n.star, i.window_min, round(i.ret, 9) AS ret FROM news_items n JOIN i USING (news_id)",
    "k11_predictions": f"WITH {_e._PRED} SELECT rec_id, label, pred FROM q WHERE split = 'test'",
    "l5_encoded": f"WITH v AS (SELECT rec_id, [{_COUNTS}] AS v FROM bert_finetune_cls WHERE text IS NOT NULL) SELECT rec_id, v[1] AS letters, v[2] AS digits, v[3] AS han FROM bert_finetune_cls LEFT JOIN v USING (rec_id)",
    "l4_scored": f"WITH v AS (SELECT rec_id, [{_COUNTS}] AS v FROM bert_finetune_cls WHERE text IS NOT NULL), m AS (SELECT rec_id, list_transform(v, lambda x: exp((x - list_max(v)) / 10)) AS e FROM v) SELECT rec_id, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS class_id, round(list_max(e) / list_sum(e), 6) AS confidence FROM m",
}
