from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.operators import tfidf
from tideline.plans import corpus


def test_classifier_beyond_bigrams(spark):
    """Both texts have the same bigrams."""
    d = spark.createDataFrame([(i, ("abacab", "acabab")[i % 2], float(i % 2)) for i in range(20)], "rec_id bigint, text string, y double")
    got = tfidf.linear_classifier(d, "text", "y").transform(d.withColumn("grams", tfidf.grams(F.col("text"))))
    assert all(r.pred == r.y for r in got.collect())
    assert got.first().tf.size >= 200_000


def test_whole_range_is_registered(spark, tmp_path):
    rows = [(i, "train" if i < 4 else "test", "abcde") for i in range(5)]
    spark.createDataFrame(rows, "rec_id bigint, split string, text string").write.parquet(f"{tmp_path}/bert_finetune_cls.parquet")
    terms = {r.term for r in corpus.QUERIES["l1_tfidf_idf_2_4"](spark, str(tmp_path)).collect()}
    assert terms == {"abcde"[i : i + n] for n in (2, 3, 4) for i in range(6 - n)}
    assert corpus.QUERIES["l1_tfidf_weights_2_4"](spark, str(tmp_path)).first().terms == 9


@pytest.mark.parametrize("many", [tfidf.MANY, 1])
def test_repeated_keys(spark, monkeypatch, many):
    """Texts of one key count as one, whether they fit a row or not; a null key is a key."""
    monkeypatch.setattr(tfidf, "MANY", many)
    rows = [(1, "abab"), (1, "ABc"), (2, "x"), (3, ""), (4, None), (None, "abab"), (None, "ba"), (5, "金价回金价")]
    got = {(r.k, r.term): r.tf for r in tfidf.terms(spark.createDataFrame(rows, "k int, t string"), "k", "t", 2, 3).collect()}
    assert got == Counter((k, t.lower()[i : i + n]) for k, t in rows if t for n in (2, 3) for i in range(len(t) - n + 1))


def test_nothing_is_gathered_in_the_driver(spark):
    """Neither the model nor the norms are broadcast, however small they are."""
    d = spark.createDataFrame([(i, "abcd" + "xyz"[i % 3]) for i in range(9)], "k int, t string")
    w = tfidf.transform(d, tfidf.fit(d, "k", "t"), "k", "t")
    assert w.count() == 9 * 9 and len(w.collect()) == 81
    assert "BroadcastHashJoin" not in w._jdf.queryExecution().executedPlan().toString()
