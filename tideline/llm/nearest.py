"""Nearest record in time of the same entity, within a tolerance.

The universe of an entity's timestamps (microseconds) is cut into blocks by its
high bits; (entity, block) is the key by which both tables are partitioned. In
a block an x-fast trie is held as hash tables, one a prefix length: a prefix of
the bits leads to the first and last record below it. A binary search over the
prefix length finds the longest prefix a query shares with any record; the
pointers at that node give predecessor and successor, the nearer one counts.
All queries of a batch go through the search together.

Records within the tolerance of a block's edge also stand in the neighbouring
block, so one task answers each query. Blocks with very many queries are split
by salt, with their records repeated; which ones they are is counted first.

Defined results: records without entity, time or value (null or NaN) are no
candidates; queries without entity or time give no row; the tolerance is
inclusive; ties go to the earlier time, then to the lowest record id; empty
tables give no rows; clashing column names cannot meet, as only the named
columns are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import hot_keys

#: Bits of a block (2^30 us, about 18 minutes), unless the tolerance needs a longer one.
BLOCK_BITS = 30
#: Queries of one (entity, block) above which it is salted.
HOT = 200_000
#: Rows gathered before complete groups are answered.
CHUNK = 100_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class PrefixTable:
    """Open addressing: prefix to (first, last) position, built in one sweep."""

    def __init__(self, prefixes: np.ndarray) -> None:
        """prefixes: sorted, one for each record, with repeats."""
        head = np.flatnonzero(np.append(True, prefixes[1:] != prefixes[:-1]))
        self.keys = prefixes[head]
        self.first, self.last = head.astype(np.int32), (np.append(head[1:], len(prefixes)) - 1).astype(np.int32)
        self.shift = np.uint64(64 - max(4, int(2 * len(head) - 1).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        todo, at = np.arange(len(head)), self._hash(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _hash(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * _GOLDEN) >> self.shift).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Index of each prefix in keys, or -1."""
        out = np.full(len(k), -1, np.int64)
        todo, at = np.arange(len(k)), self._hash(k)
        while len(todo):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == k[todo])
            out[todo[hit]] = got[hit]
            on = (got >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out


class XFastTrie:
    """Keys: group number in the high bits, ``bits`` bits of time below."""

    def __init__(self, keys: np.ndarray, bits: int) -> None:
        """keys: sorted and unique."""
        self.keys, self.bits = keys, bits
        self.levels = [PrefixTable(keys >> (bits - n)) for n in range(bits + 1)]

    def neighbours(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the last key <= q and the first key >= q of q's group; -1: none."""
        lo, hi = np.full(len(q), -1), np.full(len(q), self.bits)  # the longest known prefix; the longest possible
        node = np.full(len(q), -1, np.int64)
        while (on := lo < hi).any():
            mid = (lo + hi + 1) // 2
            for n in np.unique(mid[on]):
                rows = np.flatnonzero(on & (mid == n))
                at = self.levels[n].find(q[rows] >> (self.bits - n))
                hit = at >= 0
                lo[rows[hit]], node[rows[hit]] = n, at[hit]
                hi[rows[~hit]] = n - 1
        pred, succ = np.full(len(q), -1, np.int64), np.full(len(q), -1, np.int64)
        for n in np.unique(lo[lo >= 0]):
            rows = np.flatnonzero(lo == n)
            first, last = self.levels[n].first[node[rows]], self.levels[n].last[node[rows]]
            if n == self.bits:
                pred[rows] = succ[rows] = first
                continue
            right = ((q[rows] >> (self.bits - n - 1)) & 1).astype(bool)
            # all keys below the node lie on one side of q
            pred[rows] = np.where(right, last, first - 1)
            succ[rows] = np.where(right, last + 1, first)
        group = q >> self.bits
        for side in (pred, succ):
            side[side >= len(self.keys)] = -1
            ok = side >= 0
            side[ok & (self.keys[np.maximum(side, 0)] >> self.bits != group)] = -1
        return pred, succ


def _answer(t: pa.Table, tolerance: int, bits: int) -> pa.RecordBatch:
    """t: complete groups, sorted by group, query flag, time, id."""
    group, is_q, at, ids = (t.column(c).to_numpy() for c in ("group", "is_query", "at", "id"))
    dense = np.cumsum(np.append(0, group[1:] != group[:-1]))
    key = (dense.astype(np.int64) << bits) | at
    r, q = np.flatnonzero(is_q == 0), np.flatnonzero(is_q == 1)
    empty = np.empty(0, np.int64)
    if not len(r) or not len(q):
        return pa.RecordBatch.from_arrays([pa.array(empty), pa.array(empty)], ["query_id", "record_id"])
    first = np.append(True, key[r][1:] != key[r][:-1])  # the lowest id of equal times comes first
    r = r[first]
    trie = XFastTrie(key[r], bits)
    pred, succ = trie.neighbours(key[q])
    far = np.int64(1) << 62
    dp = np.where(pred >= 0, key[q] - key[r][np.maximum(pred, 0)], far)
    ds = np.where(succ >= 0, key[r][np.maximum(succ, 0)] - key[q], far)
    use = np.where(dp <= ds, pred, succ)
    ok = np.minimum(dp, ds) <= tolerance
    return pa.RecordBatch.from_arrays([pa.array(ids[q[ok]]), pa.array(ids[r[use[ok]]])], ["query_id", "record_id"])


def _matcher(tolerance: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < CHUNK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            g = t.column("group").to_numpy()
            whole = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if whole:
                yield _answer(t.slice(0, whole), tolerance, bits)
            held = t.slice(whole).to_batches()
            rows = t.num_rows - whole
        if rows:
            yield _answer(pa.Table.from_batches(held).combine_chunks(), tolerance, bits)

    return run


def nearest(
    queries: DataFrame, records: DataFrame, tolerance_us: int,
) -> DataFrame:
    """(query_id, record_id) from queries (query_id, entity, at) and records
    (record_id, entity, at); ``at`` is bigint microseconds.

    Blocks are at least four tolerances long, so a record stands in two of them
    at most; a negative tolerance is an error, one above 2^40 us (twelve days) too.
    """
    if not 0 <= tolerance_us <= 1 << 40:
        raise ValueError("the tolerance must be between 0 and 2^40 microseconds")
    block_bits = max(BLOCK_BITS, (4 * tolerance_us - 1).bit_length())
    size = 1 << block_bits
    q = queries.where("query_id is not null and entity is not null and at is not null").withColumn("block", F.shiftright("at", block_bits))
    r = records.where("record_id is not null and entity is not null and at is not null")
    r = r.groupBy("entity", "at").agg(F.min("record_id").alias("record_id"))
    edges = [F.shiftright(F.col("at") + d, block_bits) for d in (-tolerance_us, 0, tolerance_us)]
    r = r.withColumn("block", F.explode(F.array_distinct(F.array(*edges))))
    hot = F.broadcast(hot_keys(q, ["entity", "block"], hot=HOT))  # fewer than session.HOT_KEYS rows
    q = q.join(hot, ["entity", "block"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("query_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    r = r.join(hot, ["entity", "block"], "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    inside = (F.col("at") - F.col("block") * size + tolerance_us).alias("at")
    key = ["entity", "block", "salt"]
    both = q.select(*key, F.lit(1).cast("tinyint").alias("is_query"), inside, F.col("query_id").alias("id")).unionAll(
        r.select(*key, F.lit(0).cast("tinyint").alias("is_query"), inside, F.col("record_id").alias("id")))
    both = both.repartition(*key).sortWithinPartitions(*key, "is_query", "at", "id")
    both = both.select(F.concat_ws("\u0001", *key).alias("group"), "is_query", "at", "id")
    return both.mapInArrow(_matcher(tolerance_us, block_bits + 1), "query_id bigint, record_id bigint")


def micros(c: Column) -> Column:
    """bigint microseconds of a TIMESTAMP_NTZ, read as UTC."""
    return F.unix_micros(c.cast("timestamp"))


def news_to_bars(news: DataFrame, bars: DataFrame, tolerance_seconds: int = 90) -> DataFrame:
    """(news_id, bar_id): news.ts is wall time at UTC+8, bars.ts_utc is UTC."""
    q = news.select(F.col("news_id").alias("query_id"), F.col("ticker").alias("entity"), (micros(F.col("ts")) - 8 * 3600 * 1_000_000).alias("at"))
    r = bars.where("close is not null and not isnan(close)").select(
        F.col("bar_id").alias("record_id"), F.col("ticker").alias("entity"), micros(F.col("ts_utc")).alias("at"))
    return nearest(q, r, tolerance_seconds * 1_000_000).select(
        F.col("query_id").alias("news_id"), F.col("record_id").alias("bar_id"))
