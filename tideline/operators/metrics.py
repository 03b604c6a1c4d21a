"""Evaluation and data-quality aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = [-1, 0, 1]


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row a true label of LABELS, one column a predicted one; absent pairs are 0."""
    base = df.sparkSession.createDataFrame([(x,) for x in LABELS], "label int")
    got = df.groupBy(F.col(truth).cast("int").alias("label")).agg(
        *[F.count_if(F.col(pred) == x).alias(f"pred_{x}".replace("-", "m")) for x in LABELS])
    return base.join(got, "label", "left").na.fill(0)


def per_class(df: DataFrame, truth: str, pred: str, eps: float = 0.0) -> DataFrame:
    """(label, precision, recall, f1, support); a zero divisor gives 0. One pass over the data."""
    c = lambda x: F.count_if(x)
    cols = []
    for x in LABELS:
        t, p = F.col(truth) == x, F.col(pred) == x
        cols += [F.struct(F.lit(x).alias("label"), c(t & p).alias("tp"), c(p).alias("np"), c(t).alias("support"))]
    d = df.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    ratio = lambda a, b: F.coalesce((a + F.lit(0.0)) / F.nullif(b + F.lit(eps), F.lit(0.0)), F.lit(0.0))
    d = d.withColumns({"precision": ratio(F.col("tp"), F.col("np")), "recall": ratio(F.col("tp"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return d.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def summary(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(n, accuracy, macro_f1): macro over the three labels."""
    m = per_class(df, truth, pred).agg(F.avg("f1").alias("macro_f1"))
    a = df.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(pred)).cast("int")).alias("accuracy"))
    return a.crossJoin(F.broadcast(m)).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support) of every label seen as truth or prediction, then macro, weighted and accuracy.

    One pass counts pairs of labels; what follows works on those few rows. A zero
    divisor gives 0; the accuracy stands in all three columns.
    """
    n = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(F.count("*").alias("n"))
    sides = n.select(F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("np"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("np"), F.lit(0).cast("bigint").alias("tp")))).alias("s")).select("s.*")
    c = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("np").alias("np"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("np")), "recall": ratio(F.col("tp"), F.col("support"))})
    names = ["precision", "recall", "f1"]
    c = c.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
    six = lambda x, name: F.round(x, 6).alias(name)
    total = F.sum("support")
    last = c.agg(F.array(
        F.struct(F.lit("macro").alias("label"), *[six(F.avg(x), x) for x in names], total.alias("support")),
        F.struct(F.lit("weighted").alias("label"), *[six(F.sum(F.col(x) * F.col("support")) / total, x) for x in names], total.alias("support")),
        F.struct(F.lit("accuracy").alias("label"), *[six(F.sum("tp") / total, x) for x in names], total.alias("support"))).alias("a"))
    return c.select("label", *[six(F.col(x), x) for x in names], "support").unionAll(last.select(F.explode("a").alias("r")).select("r.*"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): N / (K n), 0 for a class without rows."""
    cols = [F.struct(F.lit(x).alias("label"), F.count_if(F.col(label) == x).alias("n")) for x in LABELS]
    d = df.agg(F.array(*cols).alias("a"), F.count(F.when(F.col(label).isin(LABELS), 1)).alias("total"))
    d = d.select("total", F.explode("a").alias("r")).select("total", "r.*")
    return d.select("label", "n", F.round(F.coalesce(F.col("total") / F.nullif(F.col("n") * len(LABELS), F.lit(0)), F.lit(0.0)), 6).alias("weight"))


def top_and_other(df: DataFrame, c: str, keep: int = 4) -> DataFrame:
    """(category, n): the ``keep`` most frequent values, the rest summed as Other if there are more than keep + 1."""
    n = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), F.asc("v")).limit(keep).select(F.col("v").alias("t"), F.lit(True).alias("top"))
    kinds = n.agg(F.count("*").alias("kinds"))
    r = n.join(F.broadcast(top), n["v"].eqNullSafe(top["t"]), "left").crossJoin(F.broadcast(kinds))
    other = F.col("top").isNull() & (F.col("kinds") > keep + 1)
    return r.groupBy(F.when(other, "Other").otherwise(F.coalesce("v", F.lit("(null)"))).alias("category")).agg(F.sum("n").alias("n"))
