"""Pairs that a stream finds as its articles arrive: none is missed, in whatever order they come."""

import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.functions.text import embedding_text
from presswork.operators.embed import hash_vectors
from presswork.streaming import bursts as stream

from .test_stream_bursts import ARTICLES, stories


@pytest.mark.parametrize("block", [8192, 7])
def test_no_pair_is_missed(spark, tmp_path, monkeypatch, block):
    rows = stories(80, seed=6)
    random.Random(3).shuffle(rows)
    vectors = hash_vectors(spark.createDataFrame(rows, ARTICLES).select("id", embedding_text(F.col("title"), F.col("summary")).alias("text")))
    dense = {r.id: np.bincount(r.dims, r.ws, 768) for r in vectors.collect()}
    near = lambda x, y: x[3] != y[3] and abs(x[4] - y[4]) <= timedelta(hours=48)
    sims = {(x[0], y[0]): round(float(dense[x[0]] @ dense[y[0]]), 9) for x in rows for y in rows if x[0] in dense and y[0] in dense and near(x, y)}
    want = {k: s for k, s in sims.items() if s >= 0.6}
    assert len(want) > 20
    monkeypatch.setattr(stream, "NEW_BLOCK", block)
    monkeypatch.setattr(stream, "MET_BLOCK", block)
    for part in (rows[:30], rows[30:31], rows[31:] + rows[:2]):  # each a restart; two articles come again
        spark.createDataFrame(part, ARTICLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        flow = spark.readStream.schema(ARTICLES).parquet(str(tmp_path / "in"))
        stream.refresh_pairs(flow, vectors, *[str(tmp_path / x) for x in ("out", "seen", "check")], threshold=0.6).awaitTermination()
    found = spark.read.schema(stream.PAIRS).parquet(str(tmp_path / "out")).collect()
    assert len(found) == len(want) and {(r.anchor, r.id): r.sim for r in found} == {k: pytest.approx(s, abs=2e-9) for k, s in want.items()}
    source = {r[0]: r[3] for r in rows}
    assert all(r.source == source[r.id] for r in found)
