"""Three-tier deduplication: url, then doi, then title hash, greedily in arrival order.

A row is kept if no row kept before it shares a key; keys of dropped rows don't count. In
each round, an undecided row that is the first undecided one for all of its keys is
kept, and undecided rows that share a key with a kept row are dropped. The result is
that of the sequential loop. Rounds are written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

KEYS = ("url", "doi", "content_hash")


def by_key(df: DataFrame, key: str, order: str = "id") -> DataFrame:
    """The first row of each value of one key; rows without the key all stay. Minimums are
    partly made before the shuffle and found again by key and `order`, which is unique, so
    neither a frequent value nor rows without the key meet in one task."""
    firsts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    return df.join(firsts, [key, order], "left_semi").select(*df.columns).unionByName(df.filter(F.col(key).isNull()))


def three_tier(df: DataFrame, keys: tuple[str, ...] = KEYS, order: str = "id", history: DataFrame | None = None, ignore_empty_title: bool = False) -> DataFrame:
    """The kept rows of df, in no order. `history`: stored rows that were kept before.
    Titles without ASCII letters or digits have one common hash and count as copies;
    ignore_empty_title lets them pass."""
    if ignore_empty_title and "content_hash" in keys:
        df = df.withColumn("content_hash", F.when(F.col("content_hash") != F.sha2(F.lit(""), 256), F.col("content_hash")))
    left = df.select(order, *keys)
    for key in keys if history is not None else ():
        left = left.join(history.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    left = stored(left.select(order, *keys))
    kept = []
    while not left.isEmpty():
        firsts = left
        for key in keys:
            lowest = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(f"_{key}"))  # a minimum is partly made before the shuffle, a window isn't
            firsts = firsts.join(lowest, key, "left")
        good = F.lit(True)
        for key in keys:
            good &= F.coalesce(F.col(f"_{key}") == F.col(order), F.lit(True))
        chosen = stored(firsts.filter(good).select(order, *keys))
        kept.append(chosen)
        rest = left.join(chosen.select(order), order, "left_anti")
        for key in keys:
            rest = rest.join(chosen.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
        left = stored(rest.select(order, *keys))
    if not kept:
        return df.limit(0)
    names = kept[0].select(order)
    for more in kept[1:]:
        names = names.union(more.select(order))
    return df.join(names, order, "left_semi")
