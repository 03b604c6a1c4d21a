"""Exactly one copy of messages that were delivered at least once.

A message identifier that is a producer plus a sequence number needs no table
of all identifiers ever seen: per producer a set of disjoint ranges of seen
numbers is enough. A number outside every range is accepted and joins the
ranges; a number inside one is a surplus copy. Identifiers of any other shape
are resolved by exact lookup of the key.

Distribution: a first pass runs on each input partition without a shuffle (the
map-side combine: of a message repeated a million times one candidate a
partition is left), then candidates meet by (producer, block of numbers). Rows
known to be surplus already travel under their own row key, so no message, day
or producer can make a task large. Both passes sort by producer and number, copies
in delivery order, so that ranges close one after the other: the state of a task
is the one range that is open. A stream, where numbers come in any order, keeps
all ranges of a block (`SeenRanges`).

Defined results: null, blank and written-out nan/none/null identifiers are
never copies; a null scope (site) is a scope of its own; ties in the delivery
order are broken by the row key; an empty table gives no rows; other columns of
the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Written-out forms of a missing identifier.
MISSING = ["", "nan", "none", "null"]
#: A sequence identifier: 8 digits name the producer's day, 15 the number.
SEQUENCE = r"^[0-9]{23}$"
#: Numbers of one block meet in one task.
BLOCK = 100_000_000_000


def folded_key(c: Column) -> Column:
    """Lower case without surrounding white space; null where it is missing."""
    k = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(~k.isin(MISSING), k)


class SeenRanges:
    """Disjoint, sorted, merged ranges [lo, hi] of accepted numbers."""

    def __init__(self) -> None:
        self.lo = np.empty(0, np.int64)
        self.hi = np.empty(0, np.int64)

    def covered(self, n: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lo, n, "right") - 1
        return (at >= 0) & (n <= self.hi[at]) if len(self.lo) else np.zeros(len(n), bool)

    def offer(self, n: np.ndarray) -> np.ndarray:
        """Which of the numbers, in the order given, are accepted."""
        first = np.zeros(len(n), bool)
        first[np.unique(n, return_index=True)[1]] = True
        ok = first & ~self.covered(n)
        self.add(np.sort(n[ok]))
        return ok

    def add(self, new: np.ndarray) -> None:
        """Merge sorted numbers that no range covers."""
        if not len(new):
            return
        at = np.searchsorted(self.lo, new)
        lo, hi = np.insert(self.lo, at, new), np.insert(self.hi, at, new)
        head = np.ones(len(lo), bool)
        head[1:] = lo[1:] != hi[:-1] + 1
        self.lo, self.hi = lo[head], hi[np.append(np.flatnonzero(head)[1:] - 1, len(hi) - 1)]


class OpenRange:
    """The range that is being seen, when numbers come in order: one number of state, whatever is behind it."""

    def __init__(self) -> None:
        self.producer, self.lo, self.hi = None, 0, -1

    def offer(self, producer: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which rows a range does not cover yet; rows are sorted by producer and number."""
        if not len(number):
            return np.zeros(0, bool)
        ok = np.ones(len(number), bool)
        ok[1:] = (producer[1:] != producer[:-1]) | (number[1:] != number[:-1])
        if self.producer == producer[0]:
            ok[0] = number[0] > self.hi
        # where the last range begins: at the last row that does not follow on the one before it
        breaks = np.flatnonzero((producer[1:] != producer[:-1]) | (number[1:] > number[:-1] + 1))
        if len(breaks) or self.producer != producer[0] or number[0] > self.hi + 1:
            self.lo = int(number[breaks[-1] + 1]) if len(breaks) else int(number[0])
        self.producer, self.hi = producer[-1], int(number[-1])
        return ok


def _accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by producer, number and delivery; ``surplus`` is set where a range covers."""
    seen = OpenRange()
    for b in batches:
        surplus = b.column("surplus").to_numpy(zero_copy_only=False).copy()
        open_ = np.flatnonzero(~surplus)
        ok = seen.offer(*(b.column(c).to_numpy(zero_copy_only=False)[open_] for c in ("producer", "number")))
        surplus[open_[~ok]] = True
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("row_key", "producer", "number", "batch")), pa.array(surplus)],
            ["row_key", "producer", "number", "batch", "surplus"],
        )


_SCHEMA = "row_key bigint, producer bigint, number bigint, batch bigint, surplus boolean"


def by_ranges(df: DataFrame) -> DataFrame:
    """(row_key, producer, number, batch, surplus) for sequence identifiers.

    ``df`` has row_key, producer, number and batch; delivery order is batch,
    then row_key.
    """
    start = df.select("row_key", "producer", "number", "batch", F.lit(False).alias("surplus"))
    order = ["producer", "number", "batch", "row_key"]
    local = start.sortWithinPartitions(*order).mapInArrow(_accept, _SCHEMA)
    meet = F.when(F.col("surplus"), F.xxhash64("row_key")).otherwise(
        F.xxhash64("producer", F.expr(f"number div {BLOCK}"))
    )
    return (
        local.repartition(meet)
        .sortWithinPartitions(*order)
        .mapInArrow(_accept, _SCHEMA)
    )


def by_lookup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """row_key of every row but the first, in ``order``, of each key.

    One aggregate with map-side combine finds the row that stays; an anti-join
    on the unique row key leaves the rest, so a hot key never meets in a task.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, "row_key")).alias("f"))
    return df.select("row_key").join(first.select(F.col("f.row_key").alias("row_key")), "row_key", "left_anti")


def surplus_messages(flash: DataFrame) -> DataFrame:
    """row_key of every surplus delivery of a table row_id, batch_id, id."""
    d = flash.select(
        F.col("row_id").alias("row_key"), F.col("batch_id").alias("batch"), folded_key(F.col("id")).alias("key")
    ).where("key is not null")
    seq = d.where(F.col("key").rlike(SEQUENCE)).select(
        "row_key", "batch",
        F.substring("key", 1, 8).cast("bigint").alias("producer"),
        F.substring("key", 9, 15).cast("bigint").alias("number"),
    )
    # a null batch sorts first in an ascending sort and in a struct's minimum
    ranged = by_ranges(seq).where("surplus").select("row_key")
    odd = by_lookup(d.where(~F.col("key").rlike(SEQUENCE)), ["key"], ["batch"])
    return ranged.unionAll(odd)


def surplus_articles(articles: DataFrame) -> DataFrame:
    """row_key of every surplus delivery of a table id, site, hash, created_at."""
    d = articles.select(
        F.col("id").alias("row_key"), "created_at",
        F.lower(F.regexp_replace("site", r"(?U)^\s+|\s+$", "")).alias("site"),
        folded_key(F.col("hash")).alias("key"),
    ).where("key is not null")
    return by_lookup(d, ["site", "key"], ["created_at"])


def seen_ranges(flash: DataFrame) -> DataFrame:
    """The merged ranges themselves: (producer, lo, hi, n), one row a range."""
    from pyspark.sql import Window as W

    d = flash.select(folded_key(F.col("id")).alias("key")).where(F.col("key").rlike(SEQUENCE)).distinct()
    d = d.select(F.substring("key", 1, 8).cast("bigint").alias("producer"), F.substring("key", 9, 15).cast("bigint").alias("number"))
    block = F.expr(f"number div {BLOCK}")
    w = W.partitionBy("producer", block).orderBy("number")
    # gaps and islands inside blocks
    d = d.withColumn("island", F.col("number") - F.row_number().over(w))
    part = d.groupBy("producer", block.alias("block"), "island").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    # only ranges that touch an edge of their block, at most two a block, can go on in the next one
    edge = (F.col("lo") % BLOCK == 0) | (F.col("hi") % BLOCK == BLOCK - 1)
    v = W.partitionBy("producer").orderBy("lo")
    joined = part.where(edge).withColumn("head", (F.col("lo") != F.coalesce(F.lag("hi").over(v), F.lit(-2)) + 1).cast("int"))
    joined = joined.withColumn("run", F.sum("head").over(v)).groupBy("producer", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = part.where(~edge).select("producer", "lo", "hi").unionAll(joined.select("producer", "lo", "hi"))
    return out.select("producer", "lo", "hi", (F.col("hi") - F.col("lo") + 1).alias("n"))
