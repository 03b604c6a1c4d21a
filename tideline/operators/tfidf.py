"""Character n-gram TF-IDF as joins and aggregates, and linear classifiers on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import ngrams

#: Texts of a key that are put into one row.
MANY = 1000


def grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """All n-grams of low..high characters."""
    return F.flatten(F.array(*[ngrams(text, n) for n in range(low, high + 1)]))


def terms(df: DataFrame, key: str, text: str, low: int, high: int) -> DataFrame:
    """(key, term, tf) of all n-grams of low..high characters.

    Texts are shuffled, not their many times larger n-grams: all texts of a key
    come to one row, whose sorted n-grams stand in runs of equal ones. Only keys
    of more than MANY texts are counted by a hash of (key, term), which can spill.
    """
    d = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__t"), F.count("*").over(Window.partitionBy(key)).alias("__n"))
    many = d.where(F.col("__n") > MANY).select(key, F.explode(grams(F.col("__t"), low, high)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    d = d.where(F.col("__n") <= MANY).groupBy(key).agg(F.collect_list("__t").alias("__t"))
    d = d.select(key, F.sort_array(F.flatten(F.transform("__t", lambda t: grams(t, low, high)))).alias("__g"))
    first = lambda x, i: F.when((i == 0) | (x != F.get("__g", i - 1)), i)
    d = d.select(key, "__g", F.filter(F.transform("__g", first), lambda i: i.isNotNull()).alias("__at"))
    run = lambda at, j: F.struct(F.get("__g", at).alias("term"), (F.coalesce(F.get("__at", j + 1), F.size("__g")) - at).cast("bigint").alias("tf"))
    return d.select(key, F.inline(F.transform("__at", run))).unionAll(many)


def fit(train: DataFrame, key: str, text: str, low: int = 2, high: int = 4, min_df: int = 3, max_features: int = 200_000) -> DataFrame:
    """(term, df, idf): smoothed ln((1 + N) / (1 + df)) + 1 over the training rows; the most frequent terms if there are too many."""
    t = terms(train, key, text, low, high)
    n = train.agg(F.count("*").alias("n"))
    v = t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    v = v.orderBy(F.desc("total"), "term").limit(max_features)
    return v.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def transform(df: DataFrame, model: DataFrame, key: str, text: str, low: int = 2, high: int = 4, sublinear: bool = False, norm: str | None = "l2") -> DataFrame:
    """(key, term, weight); rows without a known term are absent.

    The join is hinted, so that the model, of up to ``max_features`` terms, is
    never gathered in the driver for a broadcast; nor are the norms, which are
    made where a key's weights are gathered.
    """
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    w = terms(df, key, text, low, high).join(model.select("term", "idf").hint("merge"), "term").select(key, "term", (tf * F.col("idf")).alias("weight"))
    if norm is None:
        return w
    size = F.sqrt(F.sum(F.col("weight") * F.col("weight"))) if norm == "l2" else F.sum(F.abs("weight"))
    w = w.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("__w"), size.alias("__size"))
    return w.select(key, "__size", F.inline("__w")).select(key, "term", (F.col("weight") / F.col("__size")).alias("weight"))


def linear_classifier(train: DataFrame, text: str, label: str, features: int = 1 << 18, low: int = 2, high: int = 4, reg: float = 1e-3, rounds: int = 20):
    """A fitted pipeline: hashed n-gram TF-IDF and one linear SVM a class, rows weighted so that classes count alike. Labels are numbers from 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import IDF, HashingTF

    p = Pipeline(stages=[
        HashingTF(inputCol="grams", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features", minDocFreq=3),
        OneVsRest(classifier=LinearSVC(maxIter=rounds, regParam=reg), labelCol=label, featuresCol="features", predictionCol="pred", weightCol="weight"),
    ])
    n = train.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    weight = n.crossJoin(F.broadcast(total)).select("__l", (F.col("total") / (F.col("kinds") * F.col("n"))).alias("weight"))
    train = train.join(F.broadcast(weight), F.col(label) == F.col("__l")).drop("__l")  # a row a class
    return p.fit(train.withColumn("grams", grams(F.coalesce(text, F.lit("")), low, high)))
