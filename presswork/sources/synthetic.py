"""Articles and interactions made up by rule, to train and try models on.

Words are syllables drawn by hash, so a topic's vocabulary is a number, not a list; every
article is made in its own row, however many there are.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a made-up user does with the articles of a topic: how far the topic is from the user's
#: own, how many articles at most, the share of each kind, and read times from and to.
INTERESTS = {
    "near": (0, 12, {"read": 0.5, "like": 0.3, "bookmark": 0.2}, (45, 400)),
    "now and then": (1, 5, {"read": 1.0}, (10, 90)),
    "unwanted": (2, 3, {"hide": 1.0}, (0, 0)),
}
SYLLABLES = ["ba", "do", "ke", "lim", "mur", "no", "pra", "qui", "ros", "sta", "tel", "vu", "wen", "xo", "yal", "zi"]


def _draw(n: int, *keys) -> Column:
    """A number under n by hash of the keys."""
    return F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys]), F.lit(n)).cast("int")


def _word(*keys) -> Column:
    syllables = F.array(*map(F.lit, SYLLABLES))
    return F.concat(*[F.get(syllables, _draw(len(SYLLABLES), i, *keys)) for i in range(3)])


def articles(spark: SparkSession, count: int = 200, topics: int = 10, vocabulary: int = 40, words: int = 30, sources: list[str] = ("source a", "source b", "source c"), seed: int = 1) -> DataFrame:
    """(id, topic, title, summary, source): articles 0..count-1, topics in turn. Two words in three
    are from the topic's `vocabulary` words, the others from one that all topics share."""

    def word(salt: str, i: Column) -> Column:
        owner = F.when(_draw(3, salt, seed, F.col("id"), i) < 2, F.col("n")).otherwise(-1)
        return _word(owner, _draw(vocabulary, "word", salt, seed, F.col("id"), i))

    said = lambda salt, n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: word(salt, i)), " ")
    made = spark.range(count).withColumn("n", (F.col("id") % topics).cast("int"))
    listed = F.array(*map(F.lit, sources))
    return made.select("id", F.concat(F.lit("topic "), "n").alias("topic"), F.initcap(said("title", 6)).alias("title"), said("summary", words).alias("summary"), F.get(listed, _draw(len(sources), "source", seed, F.col("id"))).alias("source"))


def interactions(made: DataFrame, users: int, as_of: datetime, interests: dict | None = None, seed: int = 1) -> DataFrame:
    """Interactions of users 0..users-1 with articles(): user u's own topic is the u-th in
    the order of first ids, and interests (as INTERESTS) say what happens to it and those
    after it. Articles, kinds and read times are drawn by hash; the last drawn is the oldest."""
    interests = INTERESTS if interests is None else interests
    topics = [r.topic for r in made.groupBy("topic").agg(F.min("id").alias("i")).orderBy("i").collect()]  # one a topic
    names, user = F.array(*map(F.lit, topics)), F.col("user_id")
    roles = F.array(*[F.struct(F.lit(i).alias("role"), F.get(names, ((user + step) % len(topics)).cast("int")).alias("topic"), F.lit(most).alias("most")) for i, (step, most, _, _) in enumerate(interests.values())])
    wanted = made.sparkSession.range(users).withColumnRenamed("id", "user_id").select("user_id", F.explode(roles).alias("w")).select("user_id", "w.*")
    pairs = wanted.join(made.select(F.col("id").alias("article_id"), "topic"), "topic")
    order = Window.partitionBy("user_id", "role").orderBy(F.xxhash64(F.lit(seed), "user_id", "article_id"), "article_id")
    chosen = pairs.withColumn("n", F.row_number().over(order)).filter("n <= most")
    kind, seconds, before = F.lit(None).cast("string"), F.lit(None).cast("int"), [0]
    for i, (_, most, shares, (low, high)) in enumerate(interests.values()):
        drawn, kinds = _draw(10_000, "kind", seed, user, F.col("article_id")), list(shares)
        named = F.lit(kinds[-1])
        for k in range(len(kinds) - 2, -1, -1):
            named = F.when(drawn < round(sum(shares[x] for x in kinds[: k + 1]) * 10_000), kinds[k]).otherwise(named)
        kind = F.when(F.col("role") == i, named).otherwise(kind)
        seconds = F.when(F.col("role") == i, low + _draw(high - low + 1, "time", seed, user, F.col("article_id"))).otherwise(seconds)
        before.append(before[-1] + most)
    place = F.get(F.array(*map(F.lit, before)), F.col("role")) + F.col("n")
    at = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), place.cast("int"), F.lit(0))
    rows = chosen.select((user * before[-1] + place).cast("bigint").alias("id"), "user_id", "article_id", kind.alias("interaction_type"), seconds.alias("seconds"), at.alias("created_at"))
    return rows.select("id", "user_id", "article_id", "interaction_type", F.when(F.col("interaction_type") == "read", F.col("seconds")).alias("read_time_seconds"), "created_at")
