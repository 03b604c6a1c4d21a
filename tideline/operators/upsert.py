"""Latest-wins upserts and first-seen deduplication, without a table format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def article_key() -> Column:
    """The URL; without one the content's hash in its site, source and time (nulls compare as empty).

    In the second case hash and time are the key itself, so an update never changes them.
    """
    url = F.nullif(F.trim("url"), F.lit(""))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.when(url.isNotNull(), F.concat(F.lit("u|"), F.col("url"))).otherwise(
        F.concat_ws("|", F.lit("h"), blank("hash"), blank("site"), blank("source"), blank("published_at")))


def upserted(df: DataFrame, key: Column, order: list[str], created: str) -> DataFrame:
    """One row a key: the last by ``order``, with the first ``created``; the last column of ``order`` is unique.

    Only key, order and created are aggregated, with map-side combine, so hot
    keys are harmless; the wide rows move once, in the join with the winners.
    """
    last = df.groupBy(key.alias("__key")).agg(F.max(F.struct(*order)).alias("__last"), F.min(created).alias("__created"))
    win = last.select(F.col(f"__last.{order[-1]}").alias("__id"), "__created")
    out = df.join(win, F.col(order[-1]) == F.col("__id"))
    return out.select(*[F.col("__created").alias(c) if c == created else c for c in df.columns])


def merge(target: DataFrame, batch: DataFrame, key: Column, order: list[str], created: str) -> DataFrame:
    """Target after a batch was upserted into it."""
    return upserted(target.unionByName(batch), key, order, created)


def first_seen(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, whose last column is unique; null keys as empty text."""
    k = [F.coalesce(c.cast("string"), F.lit("")).alias(f"__k{i}") for i, c in enumerate(key)]
    first = df.groupBy(*k).agg(F.min(F.struct(*order)).alias("__f")).select(F.col(f"__f.{order[-1]}").alias("__id"))
    return df.join(first, F.col(order[-1]) == F.col("__id"), "left_semi")


def message_key(id_: Column, *rest: Column) -> Column:
    """A message's own identifier; without one auto_ and the md5 of its other fields."""
    own = F.nullif(F.trim(id_), F.lit(""))
    other = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in rest])
    return F.coalesce(own, F.concat(F.lit("auto_"), F.md5(other)))


def content_hash(title: Column, content: Column) -> Column:
    """sha1 of the stripped title, a line feed and the stripped content."""
    s = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.sha1(F.concat(s(title), F.lit("\n"), s(content)))
