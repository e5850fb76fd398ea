"""Bursts found by a stream against those of the whole table."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from presswork.functions.text import embedding_text
from presswork.operators import anomaly
from presswork.operators.embed import hash_vectors
from presswork.streaming import bursts as stream

ARTICLES = "id bigint, title string, summary string, source string, published_at timestamp_ntz, fetched_at timestamp_ntz"


def stories(n=60, seed=2):
    """Six stories told by several sources with a few words changed, and others."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [rng.sample(words, 40) for _ in range(6)]
    rows = []
    for i in range(n):
        said = list(bases[i % 6]) if i % 3 else rng.sample(words, 40)
        for _ in range(rng.randrange(4)):
            said[rng.randrange(40)] = rng.choice(words)
        at = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(90))
        rows.append((i, " ".join(said[:8]), " ".join(said[8:]), f"s{rng.randrange(5)}", at, at))
    return rows + [(n, "", None, "s1", datetime(2024, 1, 1), None)]


def told(df):
    return {r.article_id: (tuple(r.related_article_ids), tuple(r.related_sources), r.mean_similarity, r.score) for r in df.collect()}


def test_stream_finds_the_bursts_of_the_whole_table(spark, tmp_path):
    rows = stories()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, ARTICLES)
    vectors = hash_vectors(df.select("id", embedding_text(F.col("title"), F.col("summary")).alias("text")))
    want = told(anomaly.bursts(df, vectors, recent=None, k=len(rows)))
    assert len(want) > 10
    for part in (rows[:25], rows[25:26], rows[26:]):  # each a restart; late ones come within the watermark
        spark.createDataFrame(part, ARTICLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        flow = spark.readStream.schema(ARTICLES).parquet(str(tmp_path / "in"))
        pairs = stream.burst_pairs(flow, flow, vectors, late="100 hours")
        pairs.writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == found.select("anchor", "id").distinct().count()
    assert told(stream.bursts(found)) == want


def test_recall_of_the_bands():
    assert stream.recall(0.82) > 0.999 and stream.recall(0.9) > 0.999999 and stream.recall(1.0) == 1.0 and stream.recall(0.3) < 0.6
