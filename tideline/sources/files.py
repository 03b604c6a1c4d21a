"""Readers and writers of the file forms the engine meets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str], drop_malformed: bool = False) -> DataFrame:
    """CSV with a header: names lower case and stripped, absent columns as empty text, everything a string.

    The schema comes from the header line, so no pass infers types.
    """
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).limit(0).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option(
        "mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE").schema(schema).csv(path)
    d = d.toDF(*[re.sub(r"^\s+|\s+$|﻿", "", n).lower() for n in names])
    return reduce(lambda x, c: x if c in x.columns else x.withColumn(c, F.lit("")), columns, d)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def response_rows(raw: Column, schema: str) -> Column:
    """Rows of an API response: an array at the top, or under data, list, items, rows or result, or one of those inside data."""
    rows = f"array<struct<{schema}>>"
    places = ["$", "$.data", "$.list", "$.items", "$.rows", "$.result", "$.data.list", "$.data.items", "$.data.rows", "$.data.result"]
    got = [F.from_json(F.get_json_object(raw, p), rows) for p in places]
    # an object read as an array is one row of nulls; only real arrays count
    real = [F.when(F.left(F.ltrim(F.get_json_object(raw, p)), F.lit(1)) == "[", g) for p, g in zip(places, got, strict=True)]
    return F.coalesce(*real)


def next_cursor(rows: Column) -> Column:
    """(max_time, last_id) of the page after this one: time and id of the last row; nulls where there is none."""
    last = F.get(rows, F.size(rows) - 1)
    return F.struct(last["time"].alias("max_time"), last["id"].alias("last_id"))


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "append", by: list[str] | None = None) -> None:
    """Fixed columns with a header in each part file."""
    w = df.select(*columns).write.mode(mode).option("header", True).option("escape", '"')
    (w.partitionBy(*by) if by else w).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_vectors(df: DataFrame, path: str, by: str) -> None:
    """Vector collection laid out for filtered search: one folder a value of ``by``, rows sorted by id."""
    df.repartition(by).sortWithinPartitions("id").write.mode("overwrite").partitionBy(by).parquet(path)


def table_summary(df: DataFrame) -> DataFrame:
    """(column, type, filled): one pass over the data."""
    d = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return d.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.col(n).alias("filled")) for n, t in df.dtypes])).alias("r")).select("r.*")
