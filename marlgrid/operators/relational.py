"""Relational operators: latest rows, paging, first-seen, set difference, keyed replacement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """One row a key: the first in the given order, which must settle ties.  The rank limit is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_seen(df: DataFrame, key: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The first `limit` rows in order, then each key's first among those."""
    return latest_per_key(df.orderBy(*order).limit(limit), [key], order)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """A page in order; limits are clamped to 1..most and offsets to 0 and above."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def optional(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """df where the conditions that are given hold."""
    return reduce(lambda d, c: d.where(c), [c for c in conditions if c is not None], df)


def any_ilike(columns: Sequence[str], pattern: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns])


def replace_by_key(current: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """current without the keys that new holds, and new."""
    return current.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def symmetric(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both directions of every edge, so that a lookup on either end is one equi-join."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    back = edges.select(F.col(dst).alias(src), F.col(src).alias(dst), *rest)
    return edges.select(src, dst, *rest).unionByName(back)


def key_difference(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys on one side only, with `side` (before or after)."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("before")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("after")))


def zero_filled(dimension: DataFrame, facts: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """facts by key for every key of the dimension, absent counts as 0."""
    return dimension.join(facts, key, "left").select(*dimension.columns, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts])


def as_of_version(versions: DataFrame, at_ms: int, key: str = "schema_version", enacted: str = "enacted_at_ms") -> DataFrame:
    """The rows of the newest version enacted by a moment."""
    live = versions.where(F.col(enacted) <= at_ms)
    newest = live.agg(F.max(key).alias(key))
    return live.join(F.broadcast(newest), key)


def within_days(column: str, days: int, today: Column) -> Column:
    """Whether a date or timestamp lies in the last days before `today`, as an interval comparison that reaches the scan."""
    return (F.col(column) >= today - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(column) <= today)
