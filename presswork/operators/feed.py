"""Feeds for all users at once; a single user is a filter on user_id."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import knn
from .blocks import Vectors, gathered, lists, with_vectors
from .embed import dense, sparse
from .listing import hidden, latest_per_user
from .storage import small, stored

COLD_REASON, NO_HISTORY_REASON, NO_MATCH_REASON = "Recent biotech news", "Recommended for you", "Recommended based on your reading interests"


def cold(articles: DataFrame, interactions: DataFrame, embedded: DataFrame, users: DataFrame, as_of: datetime, limit: int = 20, offset: int = 0, days: int = 30) -> DataFrame:
    """Each user's newest embedded articles of the last `days` days that aren't hidden.

    Of the common list of newest articles, a user needs the first limit + offset and as
    many more as the user has hidden; that many ranks meet the list.
    """
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    recent = articles.join(embedded.select("id").distinct(), "id", "left_semi").filter(F.col("published_at") >= since).select("id", "published_at")
    gone = hidden(interactions)
    hides = gone.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = stored(users.select("user_id").distinct().join(hides, "user_id", "left").select("user_id", (F.coalesce("n", F.lit(0)) + limit + offset).cast("int").alias("n")))
    most = wanted.agg(F.max("n")).first()[0] or 0
    newest = recent.orderBy(F.desc_nulls_last("published_at"), "id").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("published_at"), "id"))  # over as many rows as one user needs at most
    page = stored(newest.select(place.alias("place"), "id"))
    seen = wanted.select("user_id", F.explode(F.sequence(F.lit(1), "n")).alias("place")).join(small(page), "place")
    seen = seen.join(gone.withColumnRenamed("article_id", "id"), ["user_id", "id"], "left_anti")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("place"))
    kept = seen.withColumn("rn", rn).filter((F.col("rn") > offset) & (F.col("rn") <= offset + limit))
    return kept.select("user_id", "id", (F.col("rn") - offset).cast("bigint").alias("rn"), F.lit(0.0).alias("similarity"), F.lit(COLD_REASON).alias("reason"))


def warm(user_vectors: DataFrame, interactions: DataFrame, embedded: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """(user_id, id, sim, rn): each user's nearest articles that aren't hidden.

    Each user takes the nearest limit + offset and as many more as the user has hidden,
    so that hidden ones can't leave a gap.
    """
    gone = hidden(interactions).withColumnRenamed("article_id", "id")
    hides = gone.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    mine = dense(user_vectors, "user_id").join(hides, "user_id", "left")
    mine = mine.select(F.col("user_id").alias("id"), "dims", "ws", (F.coalesce("n", F.lit(0)) + limit + offset).alias("k"))
    near = knn.batch(mine, dense(embedded), limit + offset, but_self=False)
    kept = near.select(F.col("anchor").alias("user_id"), "id", "sim").join(gone, ["user_id", "id"], "left_anti")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("sim"), "id"))
    return kept.withColumn("rn", rn).filter((F.col("rn") > offset) & (F.col("rn") <= offset + limit)).select("user_id", "id", "sim", (F.col("rn") - offset).cast("bigint").alias("rn"))


def by_tower(user_vectors: DataFrame, interactions: DataFrame, embedded: DataFrame, tower, limit: int = 100) -> DataFrame:
    """(user_id, id, sim) as warm(), by the vectors of a two-tower model."""
    numbered = lambda df, key: df.select(key, F.sequence(F.lit(0), F.size("embedding") - 1).alias("dims"), F.col("embedding").alias("ws"))
    people = numbered(tower.embed(dense(user_vectors, "user_id"), "user", "user_id"), "user_id")
    return warm(sparse(people, "user_id"), interactions, numbered(tower.embed(dense(embedded)), "id"), limit).select("user_id", "id", "sim")


def nearest_liked(pairs: DataFrame, interactions: DataFrame, embedded: DataFrame, limit: int = 100) -> DataFrame:
    """(user_id, id, liked_id, best, kind): of each user's latest positive articles the
    one most similar to the candidate (best > 0; of equals the smaller id), and the kind
    of the latest interaction with it. pairs: (user_id, id)."""
    return with_nearest_liked(pairs.select("user_id", "id").distinct(), interactions, embedded, limit).filter("best is not null")


def with_nearest_liked(pairs: DataFrame, interactions: DataFrame, embedded: DataFrame, limit: int = 100) -> DataFrame:
    """The distinct pairs (user_id, id) with nearest_liked(): null where there is none.

    A user's candidates meet the user's at most `limit` liked articles in one matrix
    product; a block of users gets each vector once.
    """
    recent = latest_per_user(interactions, limit)
    last = recent.groupBy("user_id", F.col("article_id").alias("liked_id")).agg(F.max_by("interaction_type", F.struct("created_at", "id")).alias("kind"))
    liked = last.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("liked_id", "kind"))).alias("liked"))  # of equal similarities the first, so the smaller id
    rows = gathered(pairs, "p").select("user_id", F.col("p.id").alias("ids")).join(liked, "user_id", "left")
    needs = F.when(F.col("liked").isNotNull(), F.concat("ids", "liked.liked_id"))
    return with_vectors(rows, needs, embedded, _most_alike, "user_id bigint, id bigint, liked_id bigint, best double, kind string")


def _most_alike(rows: pa.Table, articles: pa.Table) -> pa.Table:
    known, (ids, ends), (liked, liked_ends) = Vectors(articles), lists(rows.column("ids")), lists(rows.column("liked"))
    liked_ids, kinds = liked.field("liked_id"), liked.field("kind")
    theirs, mine = known.places(ids.to_numpy()), known.places(liked_ids.to_numpy())
    best, at = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for i in range(len(rows)):
        asked, have = (np.arange(e[i], e[i + 1]) for e in (ends, liked_ends))
        asked, have = asked[theirs[asked] >= 0], have[mine[have] >= 0]
        if len(asked) and len(have):
            sims = np.round(known.matrix(theirs[asked]) @ known.matrix(mine[have]).T, 9)
            first = sims.argmax(axis=1)
            best[asked], at[asked] = sims[np.arange(len(asked)), first], have[first]
    found = pa.array(at, mask=best <= 0)
    out = [pa.array(np.repeat(rows.column("user_id").to_numpy(), np.diff(ends)), pa.int64()), ids, liked_ids.take(found), pa.array(best, mask=best <= 0), kinds.take(found)]
    return pa.table(out, names=["user_id", "id", "liked_id", "best", "kind"])


def with_reasons(feed: DataFrame, articles: DataFrame, interactions: DataFrame, embedded: DataFrame) -> DataFrame:
    """feed (user_id, id, ...) with `reason`."""
    near = nearest_liked(feed, interactions, embedded)
    titles = articles.select(F.col("id").alias("liked_id"), F.substring("title", 1, 60).alias("liked_title"))
    any_like = latest_per_user(interactions, 100).join(embedded.select(F.col("id").alias("article_id")).distinct(), "article_id", "left_semi").select("user_id").distinct().withColumn("has", F.lit(True))
    verb = F.create_map(F.lit("bookmark"), F.lit("bookmarked"), F.lit("like"), F.lit("liked"), F.lit("read"), F.lit("read"))[F.col("kind")]
    similar = F.concat(F.lit("Similar to article you "), verb, F.lit(": "), F.col("liked_title"), F.lit("..."))
    out = feed.join(near, ["user_id", "id"], "left").join(titles, "liked_id", "left").join(any_like, "user_id", "left")
    reason = F.when(F.col("has").isNull(), NO_HISTORY_REASON).when(F.col("best") > 0.3, similar).otherwise(NO_MATCH_REASON)
    return out.withColumn("reason", reason).drop("liked_id", "best", "kind", "liked_title", "has")
