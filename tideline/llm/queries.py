"""Queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import boilerplate, identifiers, leakage, nearest, overlaps, tokens
from tideline.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.excessive_lines(table(spark, d, "citations"))


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.cleaned(table(spark, d, "citations"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.news_to_bars(table(spark, d, "news_items"), table(spark, d, "prices_m1"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.pairs(table(spark, d, "bert_finetune_cls"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.report(table(spark, d, "bert_finetune_cls"))


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.coverage(table(spark, d, "bert_finetune_cls"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decoded(tokens.encoded(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("exact").select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return identifiers.found(table(spark, d, "documents"), table(spark, d, "name_list"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return identifiers.redacted(docs, table(spark, d, "name_list"))


QUERIES = {f.__name__: f for f in (p3_found, p3_cleaned, p4_found, p5_found, p5_report, p5_coverage, p6_ids, p6_decoded, p7_found, p7_report, p8_found, p8_redacted)}

_LINES = r"""
 c AS (SELECT citation_id, split_part(lower(source_file), '/', 1) AS house, lower(source_file) AS file, text
       FROM citations WHERE trim(source_file) <> ''),
 l AS (SELECT citation_id, house, file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM c WHERE text <> ''),
 t AS (SELECT *, regexp_replace(trim(regexp_replace(lower(line), '[\s\p{Z}\x{85}\x{0b}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS tpl FROM l),
 h AS (SELECT house, count(DISTINCT file) AS files FROM c GROUP BY house),
 e AS (SELECT house, tpl FROM t JOIN h USING (house) WHERE tpl <> '' GROUP BY house, tpl, files
       HAVING count(DISTINCT file) >= 5 AND count(DISTINCT file) * 100 >= 8 * files),
 f AS (SELECT citation_id, CAST(line_no AS INTEGER) AS line_no FROM t JOIN e USING (house, tpl))"""

_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _fold(c: str) -> str:
    """Tags, entities of the tables, full-width signs, case, letters and digits: folding as far as the tables need it."""
    c = f"regexp_replace({c}, '</?[A-Za-z][^<>]*>', '', 'g')"
    for entity, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        c = f"replace({c}, '&{entity};', '{sign}')"
    return rf"regexp_replace(lower(translate({c}, '{_WIDE}', '{_NARROW}')), '[^\p{{L}}\p{{N}}]+', '', 'g')"


_NEAR = rf"""
 r AS (SELECT rec_id, split, source, event_id, split = 'train' AS train, {_fold('text')} AS x FROM bert_finetune_cls WHERE split IN ('train', 'val', 'test')),
 t AS (SELECT DISTINCT train, x, regexp_replace(x, '[^\p{{Nd}}]+', '', 'g') AS d, list_distinct(list_transform(generate_series(1, length(x) - 2), lambda i: substr(x, i, 3))) AS p FROM r WHERE length(x) >= 20),
 near AS (SELECT a.x AS xa, b.x AS xb FROM t a JOIN t b ON a.train AND NOT b.train AND a.d = b.d
          WHERE len(list_intersect(a.p, b.p)) >= 0.7 * (len(a.p) + len(b.p) - len(list_intersect(a.p, b.p))) - 1e-9),
 pair AS (SELECT a.rec_id AS i, b.rec_id AS j FROM near JOIN r a ON a.train AND a.x = xa JOIN r b ON NOT b.train AND b.x = xb
          UNION SELECT a.rec_id, b.rec_id FROM r a JOIN r b ON a.train AND NOT b.train AND a.event_id = b.event_id)"""

SQL = {
    "p5_found": f"WITH {_NEAR} SELECT least(i, j) AS rec_a, greatest(i, j) AS rec_b FROM pair",
    "p5_report": f"WITH {_NEAR} SELECT split, source, count(*) AS records, count(*) FILTER (rec_id IN (SELECT j FROM pair)) AS overlapping FROM r WHERE NOT train GROUP BY split, source",
    "p7_found": f"""
WITH i AS (SELECT item_id, CASE WHEN lang = 'zh' THEN 24 ELSE 50 END AS n, {_fold('text')} AS x FROM eval_items),
 w AS (SELECT DISTINCT item_id, n, substr(x, CAST(k AS BIGINT), n) AS s FROM i, LATERAL (SELECT unnest(generate_series(1, length(x) - n + 1)) AS k) u),
 t AS (SELECT doc_id, {_fold('text')} AS x FROM documents),
 v AS (SELECT DISTINCT doc_id, substr(x, CAST(k AS BIGINT), n) AS s FROM t, (VALUES (24), (50)) q(n), LATERAL (SELECT unnest(generate_series(1, length(x) - n + 1)) AS k) u)
SELECT DISTINCT doc_id, item_id FROM v JOIN w USING (s)""",
    "p3_found": f"WITH {_LINES} SELECT * FROM f",
    "p3_cleaned": f"""
WITH {_LINES},
 g AS (SELECT citation_id, list(line_no) AS gone FROM f GROUP BY citation_id)
SELECT citation_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
FROM citations LEFT JOIN g USING (citation_id)""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_found": """
WITH n AS (SELECT news_id, ticker, ts - INTERVAL 8 HOUR AS t FROM news_items WHERE ts IS NOT NULL AND ticker IS NOT NULL),
 b AS (SELECT ticker, ts_utc AS t, min(bar_id) AS bar_id FROM prices_m1
       WHERE close IS NOT NULL AND NOT isnan(close) AND ts_utc IS NOT NULL AND ticker IS NOT NULL GROUP BY 1, 2),
 p AS (SELECT n.news_id, n.t AS q, b.t, b.bar_id FROM n ASOF JOIN b ON n.ticker = b.ticker AND n.t >= b.t),
 s AS (SELECT n.news_id, n.t AS q, b.t, b.bar_id FROM n ASOF JOIN b ON n.ticker = b.ticker AND n.t <= b.t),
 u AS (SELECT *, abs(epoch_us(q) - epoch_us(t)) AS gap FROM (SELECT * FROM p UNION ALL SELECT * FROM s)),
 r AS (SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY gap, t, bar_id) AS k FROM u WHERE gap <= 90000000)
SELECT news_id, bar_id FROM r WHERE k = 1""",
}
