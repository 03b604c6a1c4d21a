"""First deliveries of a stream, with seen ranges as the only state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.delivery import BLOCK, SEQUENCE, SeenRanges, folded_key

_OUT = "row_id bigint, producer bigint, number bigint, batch_id bigint"


def _accept(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    seen = SeenRanges()
    if state.exists:
        lo, hi = state.get
        seen.lo, seen.hi = np.array(lo, np.int64), np.array(hi, np.int64)
    rows = pd.concat(list(frames)).sort_values(["batch_id", "row_id"], kind="stable", na_position="first")
    ok = seen.offer(rows["number"].to_numpy(np.int64))
    state.update((seen.lo.tolist(), seen.hi.tolist()))
    yield rows.loc[ok, ["row_id", "producer", "number", "batch_id"]]


def accepted(stream: DataFrame) -> DataFrame:
    """(row_id, producer, number, batch_id) of the first delivery of each sequence identifier, micro-batch after micro-batch.

    The state of a (producer, block of numbers) is its ranges, so it shrinks as
    gaps close; it needs no watermark and forgets nothing. Identifiers of
    another shape belong to a keyed deduplication and are left out here.
    """
    key = folded_key(F.col("id"))
    d = stream.select("row_id", "batch_id", key.alias("key")).where(F.col("key").rlike(SEQUENCE))
    d = d.select(
        "row_id", "batch_id", F.substring("key", 1, 8).cast("bigint").alias("producer"), F.substring("key", 9, 15).cast("bigint").alias("number"))
    return d.withColumn("block", F.expr(f"number div {BLOCK}")).groupBy("producer", "block").applyInPandasWithState(
        _accept, _OUT, "lo array<bigint>, hi array<bigint>", "append", "NoTimeout")
