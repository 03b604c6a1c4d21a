"""The same transformations for streams and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, minutes: int = 5, late_minutes: int = 10) -> DataFrame:
    """Counts a tumbling window and event type; on a stream later rows than the watermark are dropped."""
    d = events.withWatermark("ts", f"{late_minutes} minutes") if events.isStreaming else events
    g = d.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, minutes: int = 10, slide: int = 5, late_minutes: int = 10) -> DataFrame:
    d = events.withWatermark("ts", f"{late_minutes} minutes") if events.isStreaming else events
    g = d.groupBy(F.window("ts", f"{minutes} minutes", f"{slide} minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap_minutes: int = 30, late_minutes: int = 10) -> DataFrame:
    d = events.withWatermark("ts", f"{late_minutes} minutes") if events.isStreaming else events
    g = d.groupBy(F.session_window("ts", f"{gap_minutes} minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def first_deliveries(events: DataFrame, key: str, late_minutes: int = 10) -> DataFrame:
    """One row a key: on a stream the state of a key is kept for the watermark only."""
    if events.isStreaming:
        return events.withWatermark("ts", f"{late_minutes} minutes").dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upserted_table(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table an `upsert_sink` keeps: each bucket's last version, or its last one before a batch; null where there is none.

    Version and bucket are folders, so which ones count is found without reading rows.
    """
    every = _versions(spark, path)
    if every is None:
        return None
    if before is not None:
        every = every.where(F.col("version") < before)
    last = every.groupBy("bucket").agg(F.max("version").alias("version"))
    return every.join(F.broadcast(last), ["bucket", "version"], "left_semi").drop("version")  # a row a bucket


def upsert_sink(path: str, key: Column, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the buckets of keys that a batch touches are merged with it and written as that batch's version.

    Buckets without a row in the batch are not read or written. A repeated batch
    merges with what was before it and writes the same folder again, so the
    result stays exactly-once.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        b = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        old = upserted_table(batch.sparkSession, path, epoch)
        if old is None:
            old = b.limit(0)
        touched = F.broadcast(b.select("bucket").distinct())  # at most ``buckets`` rows
        new = merge(old.join(touched, "bucket", "left_semi").select(*b.columns), b)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={epoch}")

    return run
