"""Bursts on streams: articles of different sources that say much the same at nearly the
same time, found as they arrive.

Each vector is cut by random planes; the sides that it lies on make the codes of its bands.
Two streams of articles are joined where a band's codes agree within the time window; the
state has codes, not vectors. The similarity of a pair found so is worked out from the
stored vectors, so what is reported is exact, and what is missed is bounded by chance
alone (recall()). refresh_pairs() keeps the vectors of what has come in a table instead, and
misses none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import embedding_text
from ..operators import anomaly, knn
from ..operators.blocks import Vectors
from ..operators.embed import dense, hash_vectors
from ..schemas import EMBEDDING_DIM
from ..shipping import ship

#: 60 bands of 10 planes miss fewer than one pair in a thousand at the detector's 0.82, and
#: fewer than one in a million at 0.9.
BANDS, ROWS = 60, 10


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The chance that a pair of this cosine similarity shares a band."""
    return 1 - (1 - (1 - math.acos(similarity) / math.pi) ** rows) ** bands


def banded(articles: DataFrame, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """(id, source, published_at, codes) of articles (id, source, published_at,
    title, summary), batch or stream. Articles without tokens have no vector and are left out."""
    ship(articles.sparkSession)
    key = F.struct("id", "source", F.col("published_at").cast("timestamp").alias("published_at")).alias("k")
    vectors = hash_vectors(articles.select(key, embedding_text(F.col("title"), F.col("summary")).alias("text")), "text", "k").select("k.*", "dims", "ws")

    def run(batches):
        planes = np.random.default_rng(seed).normal(size=(EMBEDDING_DIM, bands * rows))
        powers = 1 << np.arange(rows)
        for part in batches:
            sides = (knn._matrix(pa.table(part)) @ planes > 0).reshape(len(part), bands, rows)
            codes = (sides * powers).sum(axis=2).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * bands), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], ["id", "source", "published_at", "codes"])

    return vectors.mapInArrow(run, "id bigint, source string, published_at timestamp, codes array<int>")


def burst_pairs(left: DataFrame, right: DataFrame, embedded: DataFrame, hours: int = 48, threshold: float = 0.82, late: str | None = None, **planes) -> DataFrame:
    """(anchor, id, sim, source): pairs of two streams of articles (or the same one, read
    twice) from different sources, at most `hours` apart and of at least this similarity to
    nine digits; each pair once. Rows that come more than `late` (by default `hours`) after
    newer ones of their stream are dropped; state is kept no longer than the window.
    embedded: the stored vectors (id, dims, ws), which must have the articles' by the time
    that their batch is joined, as ingestion sees to."""
    late = late or f"{hours} hours"

    def side(articles: DataFrame, name: str) -> DataFrame:
        rows = banded(articles, **planes)
        rows = rows.select("*", F.posexplode("codes").alias("band", "code"))
        return rows.select(*[F.col(c).alias(f"{name}_{c}") for c in rows.columns]).withWatermark(f"{name}_published_at", late)

    a, b = side(left, "a"), side(right, "b")
    met = a.join(b, F.expr(f"""a_band = b_band and a_code = b_code and a_source <> b_source and a_id <> b_id
        and b_published_at between a_published_at - interval {hours} hours and a_published_at + interval {hours} hours"""))
    # a pair counts in the first band that it shares
    met = met.filter(F.expr("array_position(zip_with(a_codes, b_codes, (x, y) -> x = y), true) = a_band + 1"))
    met = met.select(F.col("a_id").alias("anchor"), F.col("b_id").alias("id"), F.col("b_source").alias("source"))
    met = met.join(embedded.toDF("anchor", "a_dims", "a_ws"), "anchor").join(embedded.toDF("id", "b_dims", "b_ws"), "id")
    weight = F.map_from_arrays("b_dims", "b_ws")
    products = F.zip_with("a_dims", "a_ws", lambda d, w: w * F.coalesce(F.try_element_at(weight, d), F.lit(0.0)))
    sim = F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), 9)
    scored = met.select("anchor", "id", F.explode(F.array(sim)).alias("sim"), "source")  # worked out once
    return scored.filter(F.col("sim") >= threshold)


def refresh_pairs(stream: DataFrame, embedded: DataFrame, store: str, seen: str, checkpoint: str, hours: int = 48, threshold: float = 0.82) -> StreamingQuery:
    """Starts a query that writes the pairs of burst_pairs() to store/batch=N as a stream's
    articles arrive, without any loss: an article meets all that are in `seen`, however late
    it comes, by matrix products. `seen` has the vectors of the articles so far by batch; of
    them those near in time to a batch's are read. An id that has come before is passed over.
    A batch that runs again after a failure replaces its own files."""

    def one(batch: DataFrame, number: int) -> None:
        spark, span = batch.sparkSession, hours * 3_600_000_000
        rows = batch.select("id", "source", F.unix_micros(F.col("published_at").cast("timestamp")).alias("at")).dropna().dropDuplicates(["id"])
        known = spark.createDataFrame([], SEEN) if number == 0 else spark.read.schema(f"{SEEN}, batch bigint").option("basePath", seen).parquet(seen).filter(F.col("batch") < number).drop("batch")
        new = rows.join(known.select("id"), "id", "left_anti").join(dense(embedded), "id").select("id", "source", "at", "dims", "ws")
        new.write.mode("overwrite").parquet(f"{seen}/batch={number}")
        new = spark.read.schema(SEEN).parquet(f"{seen}/batch={number}")
        first, last = new.agg(F.min("at"), F.max("at")).first()
        near = known.filter(F.col("at").between((first or 0) - span, (last or 0) + span))
        near_pairs(new, near, span, threshold).write.mode("overwrite").parquet(f"{store}/batch={number}")

    ship(stream.sparkSession)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SEEN = "id bigint, source string, at bigint, dims array<int>, ws array<double>"
PAIRS = "anchor bigint, id bigint, sim double, source string"
#: Rows of a block, of the new ones and of those that they meet.
NEW_BLOCK, MET_BLOCK = 8192, 32768
#: More than a product of unit vectors in 32 bits is off by: 768 terms, each by 2**-23 at most.
SLACK = 1e-4


def near_pairs(new: DataFrame, known: DataFrame, span: int, threshold: float) -> DataFrame:
    """PAIRS of new rows (SEEN) with new ones and, in both directions, with known ones, from
    different sources, at most `span` microseconds apart and of at least this similarity.
    Times are cut into buckets of the span; blocks of a bucket's new rows meet blocks of the
    rows of that bucket and of the two beside it."""
    spark = new.sparkSession
    bucket = F.floor(F.col("at") / span)
    left = new.withColumn("bucket", bucket)
    right = new.select(*[F.col(c).alias(c) for c in new.columns], F.lit(True).alias("fresh")).unionByName(known.withColumn("fresh", F.lit(False)))
    right = right.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))).join(F.broadcast(left.select("bucket").distinct()), "bucket", "left_semi")
    sizes = lambda df: df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max("n")).first()
    (buckets, most), (_, met) = sizes(left), sizes(right)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = max(1, -(-(most or 0) // NEW_BLOCK))
    slots = max(1, -(-(met or 0) // MET_BLOCK), min(-(-tasks // max(1, buckets * parts)), -(-(met or 0) // 1024)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select("*", block(parts).alias("part")).select("*", every(slots).alias("slot"))
    right = right.select("*", block(slots).alias("slot")).select("*", every(parts).alias("part"))
    key = ["bucket", "part", "slot"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_alike(span, threshold), PAIRS)


def _alike(span: int, threshold: float):
    def rows(vectors: Vectors, places: np.ndarray, width: int, kind: type) -> np.ndarray:
        row, d, w = vectors.entries(places)
        out = np.zeros((len(places), width), kind)
        out[row, d] = w
        return out

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = Vectors(left), Vectors(right)
        width = max(a.width, b.width)
        names = pa.concat_arrays([t.column("source").combine_chunks().cast(pa.string()).take(pa.array(v.order)) for t, v in ((left, a), (right, b))]).dictionary_encode()
        code = names.indices.to_numpy()
        times, others = left.column("at").to_numpy()[a.order], right.column("at").to_numpy()[b.order]
        fresh = right.column("fresh").to_numpy(zero_copy_only=False).astype(bool)[b.order]
        whole, found = rows(a, np.arange(len(a.ids)), width, np.float32), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(b.ids) if len(a.ids) else 0, knn.CORPUS_STEP):
            places = np.arange(at, min(len(b.ids), at + knn.CORPUS_STEP))
            i, j = np.divmod(np.flatnonzero(whole @ rows(b, places, width, np.float32).T >= threshold - SLACK), len(places))
            j = j + at
            good = (code[i] != code[len(a.ids) + j]) & (np.abs(times[i] - others[j]) <= span) & (a.ids[i] != b.ids[j])
            i, j = i[good], j[good]
            for k in range(0, len(i), knn.CORPUS_STEP):
                x, y = i[k : k + knn.CORPUS_STEP], j[k : k + knn.CORPUS_STEP]
                sims = np.round(np.einsum("ij,ij->i", rows(a, x, width, float), rows(b, y, width, float)), 9)
                found.append((x[sims >= threshold], y[sims >= threshold], sims[sims >= threshold]))
        i, j, sims = (np.concatenate(x) for x in zip(*found))
        back = ~fresh[j]
        anchor, other = np.concatenate([a.ids[i], b.ids[j][back]]), np.concatenate([b.ids[j], a.ids[i][back]])
        source = names.dictionary.take(pa.array(np.concatenate([code[len(a.ids) + j], code[i][back]])))
        return pa.table([pa.array(anchor, pa.int64()), pa.array(other, pa.int64()), pa.array(np.concatenate([sims, sims[back]])), source], names=["anchor", "id", "sim", "source"])

    return run


def bursts(pairs: DataFrame, hours: int = 48, threshold: float = 0.82, least_sources: int = 2) -> DataFrame:
    """The events of anomaly.bursts() from stored pairs, without its cut at the nearest 20."""
    order = Window.partitionBy("anchor").orderBy(F.desc("sim"), "id")
    return anomaly.events(pairs.dropDuplicates(["anchor", "id"]).withColumn("rn", F.row_number().over(order)), threshold, hours, least_sources)
