"""Exact vector search in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that are compared with a batch of vectors at once, and vectors of a cell of the grid.
BLOCK, CELL = 1024, 65_536
#: Bytes of query vectors that are sent to every task; more meet the corpus in a grid.
MAX_SHIPPED = 64 << 20
_HITS = "query_id bigint, id bigint, distance double"


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column without nulls as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray) -> pa.RecordBatch:
    """The k nearest of ``x`` by (distance, id) for each query, those beyond ``bound`` left out; the bound is tightened.

    Equal distances are all kept until they are sorted.
    """
    out: list[list[np.ndarray]] = [[], [], []]
    size = (x * x).sum(1)
    for i in range(0, len(queries), BLOCK):
        v = queries[i : i + BLOCK]
        d = np.maximum((v * v).sum(1)[:, None] - 2 * v @ x.T + size[None, :], 0.0)
        if d.shape[1] >= k:
            bound[i : i + BLOCK] = np.minimum(bound[i : i + BLOCK], np.partition(d, k - 1, axis=1)[:, k - 1])
        q, r = np.nonzero(d <= bound[i : i + BLOCK, None] + 1e-9)
        # exact distances for the few candidates
        out[0].append(query_ids[i + q])
        out[1].append(ids[r])
        out[2].append(((v[q] - x[r]) ** 2).sum(1))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["query_id", "id", "distance"])


def _search(q: DataFrame, c: DataFrame, k: int, max_shipped: int) -> DataFrame:
    n, dim = q.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return q.sparkSession.createDataFrame([], _HITS)
    if n * dim * 8 <= max_shipped:
        t = q.toArrow()
        shipped = q.sparkSession.sparkContext.broadcast((t.column("query_id").to_numpy(), _vectors(t.column("vector"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, queries = shipped.value
            bound = np.full(len(queries), np.inf)
            for b in batches:
                if b.num_rows:
                    yield _best(query_ids, queries, b.column("id").to_numpy(), _vectors(b.column("vector")), k, bound)

        return c.mapInArrow(run, _HITS)
    # grid: blocks of queries by cells of vectors, each pair of them one group of bounded size
    rows, cols = -(-n * dim * 8 // max(1, max_shipped)), -(-c.count() // CELL)
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(max(1, n))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    left = q.withColumns({"i": part("query_id", rows), "j": every(cols)})
    # names and attributes of its own: both sides may come from one table
    right = c.select(F.col("id").alias("row_id"), F.transform("vector", lambda x: x.cast("double")).alias("stored"), every(rows).alias("i"), part("id", cols).alias("j"))

    def cell(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        return pa.Table.from_batches([_best(
            a.column("query_id").to_numpy(), _vectors(a.column("vector")), b.column("row_id").to_numpy(), _vectors(b.column("stored")), k, np.full(a.num_rows, np.inf))])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, _HITS)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """(query_id, id, rank, distance, score): the k nearest by squared L2, ties by id; score is 1 / (1 + distance).

    ``queries``: (query_id, vector); ``corpus``: (id, vector), filtered before
    the search by whatever metadata applies. One plan with one scan of the
    corpus: up to ``max_shipped`` bytes of queries go to every task, more meet the
    corpus in a grid of bounded cells. A task keeps the bound its batches have
    set, so only what may be among the k best is handed on. Null vectors take no
    part; k of 0 gives no rows; vectors of unequal lengths are an error.
    """
    q = queries.where("vector is not null").select(F.col("query_id").cast("bigint").alias("query_id"), "vector")
    c = corpus.where("vector is not null").select(F.col("id").cast("bigint").alias("id"), "vector")
    out = _search(q, c, k, max_shipped) if k > 0 else queries.sparkSession.createDataFrame([], _HITS)
    w = W.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "rank", "distance", (1 / (1 + F.col("distance"))).alias("score"))


def in_range(queries: DataFrame, corpus: DataFrame, k: int, start: str, end: str, post_filter: bool = False, fetch: int = 3) -> DataFrame:
    """`nearest` among rows of corpus (id, vector, day) with start <= day <= end.

    The filter holds before the ranking. With ``post_filter`` fetch * k rows are
    ranked first and filtered then, so fewer than k may be left.
    """
    inside = F.col("day").between(start, end)
    if not post_filter:
        return nearest(queries, corpus.where(inside), k)
    hits = nearest(queries, corpus, fetch * k).join(corpus.where(inside).select(F.col("id").cast("bigint").alias("id")), "id", "left_semi")
    hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)
    return hits.select("query_id", "id", "rank", "distance", "score")


def normalised(vector: Column) -> Column:
    """L2 norm 1; a zero vector stays as it is."""
    n = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x / F.when(n == 0, 1.0).otherwise(n))
