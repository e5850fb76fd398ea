"""Lookups, listings and pages. Every order ends with id, so that limits are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITIVE = ["read", "bookmark", "like"]


def bounded(limit: int, least: int = 1, most: int = 200) -> int:
    if not least <= limit <= most:
        raise ValueError(f"limit must be from {least} to {most}")
    return limit


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns have these values (pushed to the scan)."""
    for column, value in keys.items():
        df = df.filter(F.col(column) == value)
    return df


def articles(df: DataFrame, source: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    df = df if source is None else df.filter(F.col("source") == source)
    return df.orderBy(F.desc_nulls_last("published_at"), "id").offset(offset).limit(bounded(limit))


def latest(df: DataFrame, column: str, limit: int = 50, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The newest rows by a time column (runs, events, relations, interactions)."""
    return df.orderBy(F.desc_nulls_last(column), *ties).limit(bounded(limit))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with `next_cursor`: offset + limit if the page is full, else null."""
    rows = df.orderBy(*order).offset(offset).limit(bounded(limit))
    full = F.count(F.lit(1)).over(Window.partitionBy()) == limit  # at most `limit` rows
    return rows.withColumn("next_cursor", F.when(full, F.lit(offset + limit)))


def ranked_log(interactions: DataFrame) -> DataFrame:
    """interactions with each row's rank among its user's newest: `_any` of all kinds,
    `_positive` of the positive ones (null for others). latest_per_user() filters by them, so
    that a stored log is sorted once for all limits."""
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id")))
    good = F.coalesce(F.col("interaction_type").isin(POSITIVE), F.lit(False))
    df = interactions.withColumn("_good", good).withColumns({"_any": rank("user_id"), "_positive": rank("user_id", "_good")})
    return df.withColumn("_positive", F.when(F.col("_good"), F.col("_positive"))).drop("_good")


def latest_per_user(interactions: DataFrame, limit: int, kinds: list[str] | None = POSITIVE) -> DataFrame:
    """Each user's newest interactions of these kinds, with their rank `rn`."""
    known = {None: "_any", tuple(POSITIVE): "_positive"}.get(kinds and tuple(kinds))
    if known in interactions.columns:
        return interactions.filter(F.col(known) <= limit).withColumn("rn", F.col(known))
    df = interactions if kinds is None else interactions.filter(F.col("interaction_type").isin(kinds))
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return df.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit)


def hidden(interactions: DataFrame) -> DataFrame:
    return interactions.filter("interaction_type = 'hide'").select("user_id", "article_id").distinct()
