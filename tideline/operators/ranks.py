"""Positions in a global order without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.session import cut


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with position from 0 in the order of unique, non-null columns ``order``.

    Rows are sorted as ranges; a row's position is its place in its range plus
    the rows of the ranges before it, which is one small row a range.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").count()
    before = sizes.select("__range", (F.sum("count").over(W.orderBy("__range")) - F.col("count")).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order)) - 1
    out = ranged.withColumn("__inside", inside).join(F.broadcast(before), "__range")
    return out.withColumn("position", F.col("__inside") + F.col("__before")).drop("__range", "__inside", "__before")
