"""Text, deduplication, retrieval and classification queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import retrieval, tfidf, upsert
from tideline.session import table


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def f1_text_fallback(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_items").select("news_id", F.coalesce(F.nullif("content", F.lit("")), "name", F.lit("")).alias("text"))


def f2_first_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bert_finetune_cls").select("rec_id", T.first_text(F.col("text"), F.col("content"), F.col("name")).alias("text"))


def x1_strip_html(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "flash").select("row_id", T.strip_html(F.col("content")).alias("text"))


def x2_clean_pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "citations").select("citation_id", F.md5(T.clean_page(F.col("text"))).alias("digest"))


def x3_clean_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "citations").select("citation_id", T.clean_lines(F.col("text")).alias("text"))


def x4_languages(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", T.language(F.col("text")).alias("language"))


def x6_file_dates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "citations").select("citation_id", T.file_date(F.col("source_file")).alias("date"))


def x7_sources(s: SparkSession, d: str) -> DataFrame:
    f = F.col("source_file")
    return table(s, d, "citations").groupBy(F.when(f.contains("H3_AP"), "broker").when(f.isNull(), "unknown").otherwise(F.lower(F.split_part(f, F.lit("/"), F.lit(1)))).alias("source")).agg(F.count("*").alias("n"))


def x8_chunks(s: SparkSession, d: str) -> DataFrame:
    c = _docs(s, d).where("length(text) > 0").withColumn("c", T.chunks(F.col("text")))
    return c.select("doc_id", F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "chunk")).select(
        "doc_id", "chunk_index", "total_chunks", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


def x9_tables(s: SparkSession, d: str) -> DataFrame:
    v = lambda c: F.col(c).cast("string")
    rows = F.array(F.array(F.lit("previous"), F.lit("consensus"), F.lit("actual")), F.array(v("previous"), v("consensus"), v("actual")))
    return table(s, d, "flash").select("row_id", T.markdown_table(rows).alias("md"))


def x10_truncate(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.left("text", F.lit(100)).alias("snippet"))


def x12_direction(s: SparkSession, d: str) -> DataFrame:
    m = F.coalesce(T.surprise_direction(F.col("text")), T.direction(F.col("text")))
    return _docs(s, d).groupBy(m.alias("mood")).agg(F.count("*").alias("n"))


def x13_routes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").select("item_id", T.query_route(F.col("text")).alias("route"))


def x15_heat(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "flash").select("row_id", T.heat(F.col("hot")).alias("level"))


def x18_present(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "flash").select("row_id", T.present(F.col("actual")).alias("actual"), T.present(F.col("previous")).alias("previous"))


def x19_bigrams(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "bert_finetune_cls").select(F.explode(T.ngrams(F.col("text"), 2)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"))


def x20_features(s: SparkSession, d: str) -> DataFrame:
    """First line, number of lines, and whether there is a table, of each document."""
    lines = F.split("text", "\n")
    return _docs(s, d).where("text is not null").select(
        "doc_id", F.left(F.get(lines, F.lit(0)), F.lit(60)).alias("title"), F.size(lines).alias("n_lines"), F.exists(lines, lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2).alias("has_table"))


def dt_event_time(s: SparkSession, d: str) -> DataFrame:
    """YYYY年M月D日 in a text, as a date; impossible days give null."""
    p = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
    g = lambda i: F.regexp_extract("time", p, i)
    at = F.try_to_timestamp(F.concat_ws("-", g(1), g(2), g(3)), F.lit("y-M-d")).cast("date")
    return table(s, d, "flash").where(F.col("time").rlike(p)).select("row_id", at.alias("day"))


def d2_first_by_id(s: SparkSession, d: str) -> DataFrame:
    """First delivery of each message; those without an id are told apart by their fields."""
    f = table(s, d, "flash").select("row_id", "id", "time", "content")
    f = f.select("row_id", upsert.message_key(F.col("id"), F.col("time"), F.col("content")).alias("key"))
    return upsert.first_seen(f, [F.col("key")], ["row_id"]).select("row_id", "key")


def d3_first_by_key(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "flash").select("row_id", "time", "indicator_name", "previous", "actual")
    return upsert.first_seen(f, [F.col(c) for c in ("time", "indicator_name", "previous", "actual")], ["row_id"]).select("row_id")


def d4_content_hash(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "articles").select("id", upsert.content_hash(F.col("title"), F.col("content")).alias("digest"))


def d6_unique_ratio(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).where("length(text) > 0").select("doc_id", F.round(T.unique_ratio(F.col("text")), 6).alias("ratio"))


def d1_union(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "flash").select(F.lit("flash").alias("src"), F.col("content").alias("text"))
    b = table(s, d, "articles").select(F.lit("articles").alias("src"), "content").withColumnRenamed("content", "text")
    return a.unionByName(b).groupBy("src").agg(F.count("*").alias("n"), F.count("text").alias("texts"))


def k1_upsert(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "articles").select("id", "url", "hash", "site", "source", "published_at", "content", "created_at", "updated_at")
    return upsert.upserted(a, upsert.article_key(), ["updated_at", "id"], "created_at").select("id", "created_at", "updated_at", F.md5(F.coalesce("content", F.lit(""))).alias("digest"))


def w4_ordinals(s: SparkSession, d: str) -> DataFrame:
    j = F.from_json("metadata", "chunk_index int, total_chunks int")
    return table(s, d, "citations").where("metadata is not null").select("citation_id", j["chunk_index"].alias("chunk_index"), j["total_chunks"].alias("total_chunks"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _queries(v: DataFrame) -> DataFrame:
    return v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def t2_topk(s: SparkSession, d: str) -> DataFrame:
    v = _vectors(s, d)
    return retrieval.nearest(_queries(v), v, 5).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def f13_filtered_topk(s: SparkSession, d: str) -> DataFrame:
    v = _vectors(s, d)
    return retrieval.nearest(_queries(v), v.where("label = 3"), 5).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def m16_normalised(s: SparkSession, d: str) -> DataFrame:
    n = retrieval.normalised(F.col("vector"))
    return _vectors(s, d).select("id", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def l1_tfidf_idf(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "bert_finetune_cls").where("split = 'train'").select("rec_id", F.coalesce("text", F.lit("")).alias("text"))
    return tfidf.fit(t, "rec_id", "text", 2, 2).select("term", "df", F.round("idf", 6).alias("idf"))


def l1_tfidf_weights(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "bert_finetune_cls").select("rec_id", "split", F.coalesce("text", F.lit("")).alias("text"))
    w = tfidf.transform(t.where("split = 'test'"), tfidf.fit(t.where("split = 'train'"), "rec_id", "text", 2, 2), "rec_id", "text", 2, 2)
    return w.groupBy("rec_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 5).alias("top"))


def l1_tfidf_idf_2_4(s: SparkSession, d: str) -> DataFrame:
    """The operator's whole range of n-grams; `l1_tfidf_idf` has the bigrams only, as its SQL."""
    t = table(s, d, "bert_finetune_cls").where("split = 'train'").select("rec_id", F.coalesce("text", F.lit("")).alias("text"))
    return tfidf.fit(t, "rec_id", "text").select("term", "df", F.round("idf", 6).alias("idf"))


def l1_tfidf_weights_2_4(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "bert_finetune_cls").select("rec_id", "split", F.coalesce("text", F.lit("")).alias("text"))
    w = tfidf.transform(t.where("split = 'test'"), tfidf.fit(t.where("split = 'train'"), "rec_id", "text"), "rec_id", "text")
    return w.groupBy("rec_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 5).alias("top"))


def l2_classifier(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "bert_finetune_cls").where("label is not null").select("rec_id", "split", F.coalesce("text", F.lit("")).alias("text"), (F.col("label") + 1).cast("double").alias("y"))
    model = tfidf.linear_classifier(t.where("split = 'train'"), "text", "y")
    test = t.where("split = 'test'").withColumn("grams", tfidf.grams(F.col("text")))
    return model.transform(test).select("rec_id", F.col("y").cast("int").alias("label"), F.col("pred").cast("int").alias("pred"))


QUERIES = {f.__name__: f for f in (
    f1_text_fallback, f2_first_text, x1_strip_html, x2_clean_pages, x3_clean_lines, x4_languages, x6_file_dates, x7_sources, x8_chunks, x9_tables, x10_truncate,
    x12_direction, x13_routes, x15_heat, x18_present, x19_bigrams, x20_features, dt_event_time, d1_union, d2_first_by_id, d3_first_by_key, d4_content_hash,
    d6_unique_ratio, k1_upsert, w4_ordinals, t2_topk, f13_filtered_topk, m16_normalised, l1_tfidf_idf, l1_tfidf_weights, l1_tfidf_idf_2_4, l1_tfidf_weights_2_4, l2_classifier)}

_FIRST = lambda cs: "coalesce(" + ", ".join(f"CASE WHEN lower(trim({c})) NOT IN ('', 'nan') THEN trim({c}) END" for c in cs) + ", '')"
_STRIP = r"regexp_replace(coalesce({c}, ''), '^[\s\x{{0b}}\x{{85}}\p{{Z}}]+|[\s\x{{0b}}\x{{85}}\p{{Z}}]+$', '', 'g')"
_COUNT = lambda ws: "(" + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INTEGER)" for w in ws) + ")"
_P = r"预期[：:]\s*([-0-9.]+)[^\n]*?公布[：:]\s*([-0-9.]+)"
_TOP = """
WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
 x AS (SELECT query_id, vec_id AS id, list_sum(list_transform(generate_series(1, 64), lambda i: pow(CAST(v[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE), 2))) AS dist FROM q, embeddings WHERE {where}),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS rank FROM x)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(1 / (1 + dist), 5) AS score FROM r WHERE rank <= 5"""
_GRAMS = """
 t AS (SELECT rec_id, split, lower(coalesce(text, '')) AS text FROM bert_finetune_cls),
 g AS (SELECT rec_id, split, substr(text, CAST(i AS BIGINT), 2) AS term FROM t, LATERAL (SELECT unnest(generate_series(1, length(text) - 1)) AS i) u),
 f AS (SELECT rec_id, split, term, count(*) AS tf FROM g GROUP BY ALL),
 m AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM t WHERE split = 'train')) / (1.0 + count(*))) + 1 AS idf FROM f WHERE split = 'train' GROUP BY term HAVING count(*) >= 3)"""
_ALL_GRAMS = """
 t AS (SELECT rec_id, split, lower(coalesce(text, '')) AS text FROM bert_finetune_cls),
 g AS (SELECT rec_id, split, substr(text, CAST(i AS BIGINT), n) AS term FROM t, (VALUES (2), (3), (4)) v(n), LATERAL (SELECT unnest(generate_series(1, length(text) - n + 1)) AS i) u),
 f AS (SELECT rec_id, split, term, count(*) AS tf FROM g GROUP BY ALL),
 m AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM t WHERE split = 'train')) / (1.0 + count(*))) + 1 AS idf FROM f WHERE split = 'train' GROUP BY term HAVING count(*) >= 3
  ORDER BY sum(tf) DESC, term LIMIT 200000)"""


def _clean_page(c: str) -> str:
    quote = lambda p: p.replace("'", "''")
    for p in (*T.CUTS, T.KEPT):
        c = f"regexp_replace({c}, '{quote(p)}', '', 'g')"
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


SQL = {
    "x2_clean_pages": f"SELECT citation_id, md5({_clean_page('text')}) AS digest FROM citations",
    "f1_text_fallback": "SELECT news_id, coalesce(nullif(content, ''), name, '') AS text FROM news_items",
    "f2_first_text": f"SELECT rec_id, {_FIRST(['text', 'content', 'name'])} AS text FROM bert_finetune_cls",
    "x1_strip_html": "SELECT row_id, trim(regexp_replace(content, '<[^>]+>', '', 'g')) AS text FROM flash",
    "x3_clean_lines": r"SELECT citation_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\x{0b}]+|[\s\x{0b}]+$', '', 'g')), lambda x: length(x) >= 3 AND NOT regexp_matches(lower(x), 'disclaimer|contact|analyst|免责声明|风险提示|联系方式|分析师|@')), chr(10)) AS text FROM citations",
    "x4_languages": "WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS h, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS l FROM documents) SELECT doc_id, CASE WHEN h IS NULL OR h + l = 0 THEN 'unknown' WHEN h / (h + l) > 0.5 THEN 'zh' WHEN h / (h + l) < 0.1 THEN 'en' ELSE 'mixed' END AS language FROM c",
    "x6_file_dates": r"WITH c AS (SELECT citation_id, coalesce(nullif(regexp_extract(source_file, 'H3_AP_?(\d{8})', 1), ''), nullif(regexp_extract(source_file, '(20\d{6})', 1), ''), '20' || nullif(regexp_extract(source_file, '-(\d{6})\.pdf$', 1), '')) AS e FROM citations) SELECT citation_id, CASE WHEN e IS NULL THEN 'unknown' ELSE substr(e, 1, 4) || '-' || substr(e, 5, 2) || '-' || substr(e, 7, 2) END AS date FROM c",
    "x7_sources": "SELECT CASE WHEN contains(source_file, 'H3_AP') THEN 'broker' WHEN source_file IS NULL THEN 'unknown' ELSE lower(split_part(source_file, '/', 1)) END AS source, count(*) AS n FROM citations GROUP BY 1",
    "x8_chunks": r"""
WITH c AS (SELECT doc_id, list_filter(list_transform(generate_series(0, length(text) - 1, 450), lambda i: substr(text, i + 1, 500)), lambda x: length(regexp_replace(x, '^[\s\x{0b}]+|[\s\x{0b}]+$', '', 'g')) > 20) AS c FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, CAST(len(c) AS INTEGER) AS total_chunks, CAST(length(c[i]) AS INTEGER) AS n, md5(c[i]) AS digest FROM c, LATERAL (SELECT unnest(generate_series(1, len(c))) AS i) u""",
    "x9_tables": "SELECT row_id, CASE WHEN trim(coalesce(previous, '')) = '' AND trim(coalesce(consensus, '')) = '' AND trim(coalesce(actual, '')) = '' THEN '' ELSE '| previous | consensus | actual |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || trim(coalesce(previous, '')) || ' | ' || trim(coalesce(consensus, '')) || ' | ' || trim(coalesce(actual, '')) || ' |' END AS md FROM flash",
    "x10_truncate": "SELECT doc_id, substr(text, 1, 100) AS snippet FROM documents",
    "x12_direction": rf"""
WITH e AS (SELECT text, TRY_CAST(regexp_extract(text, '{_P}', 1) AS DOUBLE) AS ex, TRY_CAST(regexp_extract(text, '{_P}', 2) AS DOUBLE) AS ac, regexp_matches(lower(text), '失业|unemployment|cpi|通胀|inflation') AS inv FROM documents),
 s AS (SELECT CASE WHEN ac - ex IS NULL THEN NULL WHEN abs(ac - ex) < 0.05 THEN 'neutral' WHEN (ac - ex > 0) <> inv THEN 'bullish' ELSE 'bearish' END AS a,
  CASE WHEN {_COUNT(T.BULLISH)} > {_COUNT(T.BEARISH)} THEN 'bullish' WHEN {_COUNT(T.BEARISH)} > {_COUNT(T.BULLISH)} THEN 'bearish' ELSE 'neutral' END AS b FROM e)
SELECT coalesce(a, b) AS mood, count(*) AS n FROM s GROUP BY 1""",
    "x13_routes": "SELECT item_id, CASE WHEN regexp_matches(text, '财报|营收|利润|年报|季报|业绩') THEN 'report_qa' ELSE 'news_analysis' END AS route FROM eval_items",
    "x15_heat": "SELECT row_id, CASE trim(hot) WHEN '火' THEN 1 WHEN '热' THEN 2 WHEN '沸' THEN 3 WHEN '爆' THEN 4 END AS level FROM flash",
    "x18_present": "SELECT row_id, CASE WHEN trim(actual) NOT IN ('', '--', '-', '—') THEN trim(actual) END AS actual, CASE WHEN trim(previous) NOT IN ('', '--', '-', '—') THEN trim(previous) END AS previous FROM flash",
    "x19_bigrams": "WITH t AS (SELECT lower(text) AS text FROM bert_finetune_cls WHERE length(text) > 1), g AS (SELECT substr(text, CAST(i AS BIGINT), 2) AS gram FROM t, LATERAL (SELECT unnest(generate_series(1, length(text) - 1)) AS i) u) SELECT gram, count(*) AS n FROM g GROUP BY gram",
    "x20_features": "SELECT doc_id, substr(string_split(text, chr(10))[1], 1, 60) AS title, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) > 0 AS has_table FROM documents WHERE text IS NOT NULL",
    "dt_event_time": r"SELECT row_id, TRY_CAST(regexp_extract(time, '(\d{4})年(\d{1,2})月(\d{1,2})日', 1) || '-' || lpad(regexp_extract(time, '(\d{4})年(\d{1,2})月(\d{1,2})日', 2), 2, '0') || '-' || lpad(regexp_extract(time, '(\d{4})年(\d{1,2})月(\d{1,2})日', 3), 2, '0') AS DATE) AS day FROM flash WHERE regexp_matches(time, '(\d{4})年(\d{1,2})月(\d{1,2})日')",
    "d1_union": "SELECT 'flash' AS src, count(*) AS n, count(content) AS texts FROM flash UNION ALL SELECT 'articles', count(*), count(content) FROM articles",
    "d2_first_by_id": "WITH k AS (SELECT row_id, coalesce(nullif(trim(id), ''), 'auto_' || md5(coalesce(time, '') || '|' || coalesce(content, ''))) AS key FROM flash) SELECT min(row_id) AS row_id, key FROM k GROUP BY key",
    "d3_first_by_key": "SELECT min(row_id) AS row_id FROM flash GROUP BY coalesce(time, ''), coalesce(indicator_name, ''), coalesce(previous, ''), coalesce(actual, '')",
    "d4_content_hash": f"SELECT id, sha1({_STRIP.format(c='title')} || chr(10) || {_STRIP.format(c='content')}) AS digest FROM articles",
    "d6_unique_ratio": "WITH c AS (SELECT doc_id, list_transform(generate_series(0, length(text) - 1, 20), lambda i: substr(text, i + 1, 20)) AS p FROM documents WHERE length(text) > 0) SELECT doc_id, round(len(list_distinct(p)) / len(p), 6) AS ratio FROM c",
    "k1_upsert": "WITH k AS (SELECT *, CASE WHEN nullif(trim(url), '') IS NOT NULL THEN 'u|' || url ELSE 'h|' || coalesce(hash, '') || '|' || coalesce(site, '') || '|' || coalesce(source, '') || '|' || coalesce(published_at, '') END AS k FROM articles), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY updated_at DESC NULLS LAST, id DESC) AS n, min(created_at) OVER (PARTITION BY k) AS c FROM k) SELECT id, c AS created_at, updated_at, md5(coalesce(content, '')) AS digest FROM r WHERE n = 1",
    "w4_ordinals": "SELECT citation_id, CAST(json_extract(metadata, '$.chunk_index') AS INTEGER) AS chunk_index, CAST(json_extract(metadata, '$.total_chunks') AS INTEGER) AS total_chunks FROM citations WHERE metadata IS NOT NULL",
    "t2_topk": _TOP.format(where="true"),
    "f13_filtered_topk": _TOP.format(where="label = 3"),
    "m16_normalised": "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS total FROM embeddings",
    "l1_tfidf_idf_2_4": f"WITH {_ALL_GRAMS} SELECT term, df, round(idf, 6) AS idf FROM m",
    "l1_tfidf_weights_2_4": f"WITH {_ALL_GRAMS}, w AS (SELECT rec_id, tf * idf AS w FROM f JOIN m USING (term) WHERE split = 'test') SELECT rec_id, count(*) AS terms, round(sum(w) / sqrt(sum(w * w)), 5) AS total, round(max(w) / sqrt(sum(w * w)), 5) AS top FROM w GROUP BY rec_id",
    "l1_tfidf_idf": f"WITH {_GRAMS} SELECT term, df, round(idf, 6) AS idf FROM m",
    "l1_tfidf_weights": f"WITH {_GRAMS}, w AS (SELECT rec_id, tf * idf AS w FROM f JOIN m USING (term) WHERE split = 'test') SELECT rec_id, count(*) AS terms, round(sum(w) / sqrt(sum(w * w)), 5) AS total, round(max(w) / sqrt(sum(w * w)), 5) AS top FROM w GROUP BY rec_id",
}
