"""The rest of the inventory: prefixes, overlaps of rules, filters by date, citations, chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.functions.chunking import recursive_chunks
from tideline.operators import labels, metrics, retrieval
from tideline.session import table


def _set(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bert_finetune_cls")


def _data_prefix():
    """[indicator] [ActualX ExpY] [Beat|Miss] where both numbers are there."""
    a, c = labels.number(F.col("actual")), labels.number(F.col("consensus"))
    name = F.when(F.trim("indicator_name") != "", F.col("indicator_name")).otherwise("Economic Data")
    beat = F.when(a - c > 0.01, " [Beat]").when(a - c < -0.01, " [Miss]").otherwise("")
    two = lambda x: F.format_string("%.2f", x)
    return F.when(a.isNotNull() & c.isNotNull(), F.concat(F.lit("["), name, F.lit("] [Actual"), two(a), F.lit(" Exp"), two(c), F.lit("]"), beat))


def m11_data_prefix(s: SparkSession, d: str) -> DataFrame:
    return _set(s, d).select("rec_id", _data_prefix().alias("prefix"))


def x11_enhanced_text(s: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("["), labels.trend(F.col("pre_ret"), F.col("range_ratio"), "train"), F.lit("]"))
    return _set(s, d).select("rec_id", F.concat_ws(" ", t, _data_prefix(), T.first_text(F.col("text"), F.col("content"), F.col("name"))).alias("text"))


def x5_plain_date(s: SparkSession, d: str) -> DataFrame:
    """The first six digits of a file name read as a short date, as older file lists have it."""
    g = lambda i: F.regexp_extract("source_file", r"(\d{2})(\d{2})(\d{2})", i)
    return table(s, d, "citations").select("citation_id", F.when(F.coalesce(g(1), F.lit("")) == "", "unknown").otherwise(F.concat(F.lit("20"), g(1), F.lit("-"), g(2), F.lit("-"), g(3))).alias("date"))


def x8_recursive(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "documents").select("doc_id", recursive_chunks("text").alias("c"))
    return c.select("doc_id", F.posexplode("c").alias("chunk_index", "chunk")).select("doc_id", "chunk_index", F.length("chunk").alias("n"))


def a3_abs_quantiles(s: SparkSession, d: str) -> DataFrame:
    q = {"pre80": (F.abs("pre_ret"), 0.8, 0.0), "post70": (F.abs("ret_post"), 0.7, 0.0), "range85": (F.col("range_ratio"), 0.85, 0.0), "abs20": (F.abs("ret_post"), 0.2, 0.0)}
    t = labels.quantiles(_set(s, d).where("split = 'train'"), q)
    return t.select(*[F.round(c, 9).alias(c) for c in q])


def a16_trigger_rates(s: SparkSession, d: str) -> DataFrame:
    """How often each trend tag is given, in rows and per cent."""
    n = _set(s, d).groupBy(labels.trend(F.col("pre_ret"), F.col("range_ratio"), "serve").alias("tag")).agg(F.count("*").alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("total")))
    return n.crossJoin(total).select("tag", "n", F.round(F.col("n") * 100 / F.col("total"), 4).alias("percent"))


def a19_majority(s: SparkSession, d: str) -> DataFrame:
    """The most frequent page of each file's chunks; ties go to the lower page."""
    c = table(s, d, "citations").where("source_file is not null and page_idx is not null").groupBy("source_file", "page_idx").agg(F.count("*").alias("n"))
    return c.groupBy("source_file").agg(F.max_by("page_idx", F.struct("n", -F.col("page_idx"))).alias("page_idx"))


def a22_category_scores(s: SparkSession, d: str) -> DataFrame:
    """Mean of several measures by category, from a map that is exploded."""
    m = F.create_map(F.lit("ret"), F.col("ret_post"), F.lit("pre"), F.col("pre_ret"), F.lit("range"), F.col("range_ratio"))
    e = _set(s, d).select("source", F.explode(m).alias("measure", "v"))
    return e.groupBy("source", "measure").agg(F.round(F.avg("v"), 9).alias("mean"), F.count("v").alias("n"))


def j11_batch_search(s: SparkSession, d: str) -> DataFrame:
    """Nearest neighbour of each query among the other labels."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = v.where("id % 100 = 0")
    hits = retrieval.nearest(q.select(F.col("id").alias("query_id"), "vector"), v, 3)
    own = v.select("id", "label")
    hits = hits.join(own.select(F.col("id").alias("query_id"), F.col("label").alias("query_label")), "query_id").join(own, "id")
    return hits.groupBy("query_label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("query_label")).alias("same"))


def j12_aligned_predictions(s: SparkSession, d: str) -> DataFrame:
    """Two predictors compared row by row, joined by id, never by position."""
    a = _set(s, d).where("label is not null").select("rec_id", F.col("label").cast("int").alias("a"))
    p = F.when(F.col("pre_ret") > 0.001, 1).when(F.col("pre_ret") < -0.001, -1).otherwise(0)
    b = _set(s, d).select("rec_id", p.alias("b"))
    return a.join(b, "rec_id").groupBy("a", "b").agg(F.count("*").alias("n"))


def f14_date_filter(s: SparkSession, d: str) -> DataFrame:
    """Best scored chunk of each house within a date range; the filter holds before the ranking."""
    c = table(s, d, "citations").withColumn("day", T.file_date(F.col("source_file"))).where("source_file is not null and day between '2025-03-01' and '2025-06-30'")
    house = F.lower(F.split_part("source_file", F.lit("/"), F.lit(1)))
    return c.groupBy(house.alias("house")).agg(F.max_by("citation_id", F.struct("score", -F.col("citation_id"))).alias("citation_id"))


def t7_top_citations(s: SparkSession, d: str) -> DataFrame:
    """The three best chunks of each file with a snippet, as one array; ranks need no array of all chunks."""
    c = table(s, d, "citations").where("source_file is not null and length(text) > 0")
    r = c.withColumn("k", F.row_number().over(W.partitionBy("source_file").orderBy(F.desc_nulls_last("score"), "citation_id"))).where("k <= 3")
    a = F.array_sort(F.collect_list(F.struct("k", "citation_id", F.left("text", F.lit(100)).alias("snippet"))))
    return r.groupBy("source_file").agg(a.alias("c")).select("source_file", F.transform("c", lambda x: x["citation_id"].cast("string")).alias("ids"), F.md5(F.array_join(F.transform("c", lambda x: x["snippet"]), "\n")).alias("digest"))


def m14_softmax(s: SparkSession, d: str) -> DataFrame:
    p = labels.softmax(F.array(*[F.coalesce(F.col(c) * 1000, F.lit(0.0)) for c in ("ret_post", "pre_ret", "range_ratio")]))
    return _set(s, d).select("rec_id", F.array_position(p, F.array_max(p)).cast("int").alias("best"), F.round(F.array_max(p), 6).alias("confidence"))


def m13_recode(s: SparkSession, d: str) -> DataFrame:
    """Six classes back to three: watch is flat, priced-in keeps its sign."""
    to = F.create_map(*[F.lit(x) for kv in {0: 0, 1: 1, 2: -1, 3: 1, 4: -1, 5: 0}.items() for x in kv])
    from tideline.plans.events import m9_six_classes

    return m9_six_classes(s, d).groupBy(F.element_at(to, F.col("class_id")).alias("label")).agg(F.count("*").alias("n"))


def a11_by_split(s: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("pre_ret") > 0.001, 1).when(F.col("pre_ret") < -0.001, -1).otherwise(0)
    x = _set(s, d).where("label is not null and split = 'test'").select("label", p.alias("pred"))
    return metrics.per_class(x, "label", "pred")


QUERIES = {f.__name__: f for f in (
    m11_data_prefix, x11_enhanced_text, x5_plain_date, x8_recursive, a3_abs_quantiles, a16_trigger_rates, a19_majority, a22_category_scores, j11_batch_search,
    j12_aligned_predictions, f14_date_filter, t7_top_citations, m14_softmax, m13_recode, a11_by_split)}

from tideline.plans import corpus as _c  # noqa: E402
from tideline.plans import events as _e  # noqa: E402

_A, _C = _e._NUM.format(c="actual"), _e._NUM.format(c="consensus")
_X = f"x AS (SELECT *, {_A} AS va, {_C} AS vc FROM bert_finetune_cls)"
_PREFIX = "CASE WHEN va IS NOT NULL AND vc IS NOT NULL THEN '[' || CASE WHEN trim(indicator_name) <> '' THEN indicator_name ELSE 'Economic Data' END || '] [Actual' || printf('%.2f', va) || ' Exp' || printf('%.2f', vc) || ']' || CASE WHEN va - vc > 0.01 THEN ' [Beat]' WHEN va - vc < -0.01 THEN ' [Miss]' ELSE '' END END"
_TEST = _e._PC.replace("WHERE label IS NOT NULL", "WHERE label IS NOT NULL AND split = 'test'")
_DAY = _c.SQL["x6_file_dates"].removeprefix("WITH ")

SQL = {
    "m11_data_prefix": f"WITH {_X} SELECT rec_id, {_PREFIX} AS prefix FROM x",
    "x11_enhanced_text": f"WITH {_X} SELECT rec_id, concat_ws(' ', '[' || {_e._TREND['train'].format(p='pre_ret', v='coalesce(range_ratio, 0)')} || ']', {_PREFIX}, {_c._FIRST(['text', 'content', 'name'])}) AS text FROM x",
    "x5_plain_date": r"SELECT citation_id, CASE WHEN coalesce(regexp_extract(source_file, '\d{6}', 0), '') = '' THEN 'unknown' ELSE '20' || substr(regexp_extract(source_file, '\d{6}', 0), 1, 2) || '-' || substr(regexp_extract(source_file, '\d{6}', 0), 3, 2) || '-' || substr(regexp_extract(source_file, '\d{6}', 0), 5, 2) END AS date FROM citations",
    "a3_abs_quantiles": "SELECT round(quantile_cont(abs(pre_ret), 0.8), 9) AS pre80, round(quantile_cont(abs(ret_post), 0.7), 9) AS post70, round(quantile_cont(range_ratio, 0.85), 9) AS range85, round(quantile_cont(abs(ret_post), 0.2), 9) AS abs20 FROM bert_finetune_cls WHERE split = 'train'",
    "a16_trigger_rates": f"WITH t AS (SELECT {_e._TREND['serve'].format(p='pre_ret', v='coalesce(range_ratio, 0)')} AS tag FROM bert_finetune_cls) SELECT tag, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM t), 4) AS percent FROM t GROUP BY tag",
    "a19_majority": "WITH c AS (SELECT source_file, page_idx, count(*) AS n FROM citations WHERE source_file IS NOT NULL AND page_idx IS NOT NULL GROUP BY 1, 2) SELECT source_file, page_idx FROM c QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY n DESC, page_idx) = 1",
    "a22_category_scores": "WITH e AS (SELECT source, 'ret' AS measure, ret_post AS v FROM bert_finetune_cls UNION ALL SELECT source, 'pre', pre_ret FROM bert_finetune_cls UNION ALL SELECT source, 'range', range_ratio FROM bert_finetune_cls) SELECT source, measure, round(avg(v), 9) AS mean, count(v) AS n FROM e GROUP BY source, measure",
    "j11_batch_search": "WITH h AS (" + _c._TOP.format(where="true").replace("rank <= 5", "rank <= 3") + ") SELECT q.label AS query_label, count(*) AS n, count(*) FILTER (q.label = r.label) AS same FROM h JOIN embeddings q ON q.vec_id = h.query_id JOIN embeddings r ON r.vec_id = h.id GROUP BY q.label",
    "j12_aligned_predictions": "SELECT label AS a, CASE WHEN pre_ret > 0.001 THEN 1 WHEN pre_ret < -0.001 THEN -1 ELSE 0 END AS b, count(*) AS n FROM bert_finetune_cls WHERE label IS NOT NULL GROUP BY 1, 2",
    "f14_date_filter": f"WITH f AS (WITH {_DAY}) SELECT lower(split_part(source_file, '/', 1)) AS house, arg_max(citation_id, (score, -citation_id)) AS citation_id FROM citations JOIN f USING (citation_id) WHERE source_file IS NOT NULL AND date BETWEEN '2025-03-01' AND '2025-06-30' GROUP BY 1",
    "t7_top_citations": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY score DESC NULLS LAST, citation_id) AS k FROM citations WHERE source_file IS NOT NULL AND length(text) > 0) SELECT source_file, list(CAST(citation_id AS VARCHAR) ORDER BY k) AS ids, md5(string_agg(substr(text, 1, 100), chr(10) ORDER BY k)) AS digest FROM r WHERE k <= 3 GROUP BY source_file",
    "m14_softmax": "WITH s AS (SELECT rec_id, coalesce(ret_post * 1000, 0.0) AS a, coalesce(pre_ret * 1000, 0.0) AS b, coalesce(range_ratio * 1000, 0.0) AS c FROM bert_finetune_cls), m AS (SELECT *, greatest(a, b, c) AS g FROM s) SELECT rec_id, CASE WHEN a = g THEN 1 WHEN b = g THEN 2 ELSE 3 END AS best, round(1 / (exp(a - g) + exp(b - g) + exp(c - g)), 6) AS confidence FROM m",
    "m13_recode": "WITH y AS (" + _e.SQL["m9_six_classes"] + ") SELECT CASE class_id WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN 1 WHEN 4 THEN -1 ELSE 0 END AS label, count(*) AS n FROM y GROUP BY 1",
    "a11_by_split": f"WITH {_TEST} SELECT * FROM m",
}
