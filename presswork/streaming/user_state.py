"""User vectors kept up to date by a stream of interactions.

A user's vector depends on the user's latest 500 positive interactions, so these are the
state: a list for each user, in the order of time whatever the order of arrival. A batch
reads and writes the lists of its own users only; the log is never read again. What leaves
the operator are the changed users' weights, from which their vectors are made by the
same join as for all users at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import users
from ..operators.embed import dense
from ..operators.listing import POSITIVE
from ..shipping import ship

ITEM = "micros bigint, id bigint, article_id bigint, weight double"
STATE_OUT = "user_id bigint, article_ids array<bigint>, weights array<double>, interaction_count bigint, gone boolean"
#: The state store that lists and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestInteractions(StatefulProcessor):
    """Of each user the latest `limit` interactions by (time, id), each id once; those of a
    user who has been idle for `idle_ms` of event time are dropped, and the user is
    reported as gone."""

    def __init__(self, limit: int, count_limit: int, idle_ms: int | None):
        self.limit, self.count_limit, self.idle_ms = limit, count_limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("latest", ITEM)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {row[1]: tuple(row) for row in self.items.get()}
        before = list(kept.values())
        for part in rows:
            # of rows with one id the latest, so that the order of arrival doesn't matter
            for item in part[["micros", "id", "article_id", "weight"]].itertuples(index=False, name=None):
                item = (int(item[0]), int(item[1]), int(item[2]), float(item[3]))
                kept[item[1]] = max(item, kept.get(item[1], item))
        latest = sorted(kept.values(), reverse=True)[: self.limit]
        if latest == before:
            return
        self.items.put(latest)
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest[0][0] // 1000 + self.idle_ms)
        weights: dict[int, float] = {}
        for _, _, article, weight in sorted(latest):
            weights[article] = weights.get(article, 0.0) + weight
        yield self._row(key[0], list(weights), list(weights.values()), min(len(latest), self.count_limit), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.items.clear()
        yield self._row(key[0], [], [], 0, True)

    @staticmethod
    def _row(user: int, articles: list[int], weights: list[float], count: int, gone: bool) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [int(user)], "article_ids": [articles], "weights": [weights], "interaction_count": [count], "gone": [gone]})

    def close(self) -> None:
        pass


def user_states(stream: DataFrame, limit: int = 500, count_limit: int = 200, full_read: float = 300.0, late: str = "30 days", idle_days: int | None = None) -> DataFrame:
    """(user_id, article_ids, weights, interaction_count, gone) of the users whose latest
    positive interactions a batch changes. stream: interactions with created_at.

    Repeated rows count once, by their id; rows without a user, id, article or time have no
    part. With idle_days, users are forgotten after so much event time without a new
    interaction, and rows that come more than `late` after newer ones are dropped by the
    watermark; without, there is neither and every row counts however late it comes.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    time = F.col("created_at").cast("timestamp")
    rows = stream.filter(F.col("interaction_type").isin(POSITIVE)).withColumn("_time", time)
    rows = rows.select("user_id", F.unix_micros("_time").alias("micros"), "id", "article_id", users.weight(full_read).alias("weight"), "_time").dropna(subset=["user_id", "id", "article_id", "_time"])
    if idle_days is not None:
        rows = rows.withWatermark("_time", late)
    processor = LatestInteractions(limit, count_limit, None if idle_days is None else idle_days * 86_400_000)
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=STATE_OUT, outputMode="Update", timeMode="None" if idle_days is None else "EventTime")


def refresh_users(stream: DataFrame, embedded: DataFrame, store: str, checkpoint: str, least: int = 1, **settings) -> StreamingQuery:
    """Starts a query that writes the vectors of the users a batch changes to store/batch=N:
    (user_id, dims, ws, interaction_count, gone), one row a user. A batch that runs again
    after a failure replaces its own files. settings as for user_states()."""

    def one(batch: DataFrame, number: int) -> None:
        changed = batch.persist()  # of one batch's users
        pairs = changed.select("user_id", F.explode(F.arrays_zip("article_ids", "weights")).alias("p")).select("user_id", F.col("p.article_ids").alias("article_id"), F.col("p.weights").alias("weight"))
        vectors = dense(users.combined(pairs, embedded), "user_id")
        rows = changed.select("user_id", "interaction_count", "gone").join(vectors, "user_id", "left")
        # users with too few interactions, or without a vector, are gone as far as feeds go
        gone = F.col("gone") | F.col("dims").isNull() | (F.col("interaction_count") < least)
        rows.withColumn("gone", gone).write.mode("overwrite").parquet(f"{store}/batch={number}")
        changed.unpersist()

    return user_states(stream, **settings).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


VECTORS = "user_id bigint, interaction_count bigint, gone boolean, dims array<int>, ws array<double>, batch bigint"


def current_vectors(spark: SparkSession, store: str) -> DataFrame:
    """(user_id, dims, ws, interaction_count) of every user, by the last batch with the user."""
    rows = spark.read.schema(VECTORS).option("basePath", store).parquet(store)
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("dims", "ws", "interaction_count", "gone"), "batch").alias("v"))
    return last.filter("not v.gone").select("user_id", "v.dims", "v.ws", "v.interaction_count")
