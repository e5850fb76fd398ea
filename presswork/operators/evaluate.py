"""Ranking quality, latency percentiles and load summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import knn
from .embed import EMBEDDERS, dense
from .storage import small, stored


def retrieval(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10), ndcg_at: int = 10, sizes: DataFrame | None = None) -> DataFrame:
    """One row: n_queries, hit_rate_at_k (a relevant item in the first k) and ndcg_at_k.
    ranked: (query, id, rank from 1); relevant: (query, id). Queries without relevant
    items count with 0. sizes: (query, n_rel over 0), if `relevant` has only the ranked ones."""
    truth = relevant.select("query", "id").distinct()
    if sizes is None:
        sizes = truth.groupBy("query").agg(F.count(F.lit(1)).alias("n_rel"))
    hits = ranked.filter(F.col("rank") <= max(*ks, ndcg_at)).join(truth.withColumn("rel", F.lit(1)), ["query", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    dcg = F.sum(F.when(F.col("rank") <= ndcg_at, F.col("rel") / F.log2(F.col("rank") + 1)))
    each = hits.groupBy("query").agg(dcg.alias("dcg"), *[F.max(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"hit{k}") for k in ks]).join(sizes, "query", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(ndcg_at)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    ndcg = F.when(F.coalesce("n_rel", F.lit(0)) > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0)
    return each.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(f"hit{k}"), 4).alias(f"hit_rate_at_{k}") for k in ks], F.round(F.avg(ndcg), 4).alias(f"ndcg_at_{ndcg_at}"))


def search_quality(articles: DataFrame, queries: DataFrame, backend: str = "hash", ks: tuple[int, ...] = (5, 10), ndcg_at: int = 10) -> DataFrame:
    """retrieval() of semantic searches: articles (id, title, summary), queries (query, text,
    relevant: array of ids). Title and summary are embedded together, set apart by a space."""
    text = F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")))
    corpus = dense(EMBEDDERS[backend](articles.select("id", text.alias("text")), "text", "id"))
    asked = dense(EMBEDDERS[backend](queries.select(F.col("query").alias("id"), "text"), "text", "id"))
    ranked = knn.batch(asked, corpus, max(*ks, ndcg_at), but_self=False).select(F.col("anchor").alias("query"), "id", F.col("rn").alias("rank"))
    return retrieval(ranked, queries.select("query", F.explode("relevant").alias("id")), ks, ndcg_at)


#: Bits of a value's code that each pass of the selection reads, so a histogram of one
#: bucket has at most 2**16 rows.
DIGIT_BITS, PASSES = 16, 4


def percentiles(df: DataFrame, column: str, by: list[str] = (), points: tuple[float, ...] = (50, 95, 99), digits: int = 4) -> DataFrame:
    """Exact percentiles with linear interpolation, p50 and so on, of groups of any size.

    A percentile lies between the values of two ranks. Values are counted by the first
    digit of a code that sorts as they do; the bucket that holds a wanted rank is known
    from the counts, and only its values are counted by the next digit, until a bucket has
    one value. So no task holds a group's values, but at most a histogram of one bucket.
    Nulls don't count; NaN is the largest value; a group of nulls has null percentiles,
    and a null in `by` is a group."""
    group = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.struct(F.lit(0).alias("all"))
    value = F.col(f"`{column}`").cast("double") + F.lit(0.0)  # -0.0 is 0.0
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col("v")).cast("bigint")
    # unsigned codes: the sign bit is turned, and all others of negative values
    code = F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(2**63))))
    rows = df.select(group.alias("g"), value.alias("v"))
    counts = stored(rows.groupBy("g").agg(F.count("v").alias("n")))
    coded = rows.filter("v is not null").select("g", "v", code.alias("code"))
    places = F.array(*[F.struct(F.lit(str(p)).alias("p"), ((F.col("n") - 1) * (p / 100)).alias("at")) for p in points])
    wanted = counts.filter("n > 0").select("g", F.explode(places).alias("x")).select("g", "x.p", "x.at")
    ranks = wanted.select("g", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")).distinct()
    open_ = stored(ranks.select("g", "rank", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("below")))
    settled = []
    for i in range(PASSES):
        upto = lambda k: F.shiftrightunsigned("code", 64 - DIGIT_BITS * k) if k else F.lit(0).cast("bigint")
        buckets = small(open_.select("g", "prefix").distinct())
        inside = coded.select("g", "v", upto(i).alias("prefix"), upto(i + 1).alias("next")).join(buckets, ["g", "prefix"], "left_semi")
        histogram = inside.groupBy("g", "prefix", "next").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("k").over(Window.partitionBy("g", "prefix").orderBy("next")) - F.col("k")
        hit = open_.join(histogram.withColumn("before", before), ["g", "prefix"])
        hit = hit.filter("rank >= below + before and rank < below + before + k")
        found = stored(hit.select("g", "rank", F.col("next").alias("prefix"), (F.col("below") + F.col("before")).alias("below"), "low", "high"))
        settled.append(found.filter("low = high").select("g", "rank", F.col("low").alias("v")))
        open_ = found.filter("low <> high").drop("low", "high")
        if open_.isEmpty():
            break
    known = reduce(DataFrame.unionByName, settled)
    low, high = known.toDF("g", "r", "low"), known.toDF("g", "r", "high")
    ends = wanted.withColumn("r", F.floor("at")).join(low, ["g", "r"]).withColumn("r", F.ceil("at")).join(high, ["g", "r"])
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high"))
    each = ends.groupBy("g").agg(*[F.max(F.when(F.col("p") == str(p), F.round(between, digits))).alias(f"p{p}") for p in points])
    whole = counts.select("g").join(each, "g", "left")
    return whole.select(*[F.col(f"g.`{c}`") for c in by], *[f"`p{p}`" for p in points])


def load_summary(samples: DataFrame, wall_seconds: float) -> DataFrame:
    """samples: (ok, total_seconds, ttft_seconds, token_count). Latencies of good ones in ms."""
    good = F.col("ok")
    totals = samples.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(good).alias("n_ok"),
        F.count_if(~good).alias("n_failed"),
        F.round(F.count_if(good) / wall_seconds, 3).alias("requests_per_second"),
        F.round(F.coalesce(F.sum(F.when(good, F.col("token_count"))), F.lit(0)) / wall_seconds, 3).alias("tokens_per_second"),
    )
    times = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_seconds") * 1000).alias("ms")) for m in ("total", "ttft")])
    long = samples.filter("ok").select(F.explode(times).alias("t")).select("t.metric", "t.ms")
    found = percentiles(long, "ms", ["metric"], digits=1)
    asked = [("total", 50), ("total", 95), ("total", 99), ("ttft", 50), ("ttft", 95)]
    row = found.agg(*[F.max(F.when(F.col("metric") == m, F.col(f"p{p}"))).alias(f"{m}_p{p}") for m, p in asked])
    return totals.join(F.broadcast(row))  # one row each
