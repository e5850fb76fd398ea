"""Blocks of anchors and of articles: exact, and no vector is copied for each block."""

import hashlib
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presswork.operators import blocks, embed, explain, feed, knn, listing, ranking, storage, users


def vectors(spark, rows):
    return knn.unit_vectors(spark.createDataFrame(rows, "v long, e array<double>"), "v", "e")


def brute(anchors, corpus, want):
    unit = lambda rows: {i: np.array(e) / np.linalg.norm(e) for i, e in rows}
    a, c, found = unit(anchors), unit(corpus), {}
    for i, x in a.items():
        sims = sorted(((-round(float(x @ y), 9), j) for j, y in c.items() if i != j))
        found[i] = [j for _, j in sims[: want(i)]]
    return found


def got(found):
    out = {}
    for r in found.orderBy("anchor", "rn").collect():
        out.setdefault(r.anchor, []).append(r.id)
    return out


@pytest.mark.parametrize("anchors_in_a_block, packed", [(7, 5), (4096, 8192)])
def test_nearest_rows_of_many_blocks_are_those_of_all_pairs(spark, monkeypatch, anchors_in_a_block, packed):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(90)] for _ in range(3)]
    corpus = [(i, [rng.gauss(0, 1) for _ in range(90)]) for i in range(60)]
    corpus += [(100 + i, corpus[i % 4][1]) for i in range(12)]  # copies: the smaller ids come first
    # sums of three vectors: more of them than 64, in a space of three dimensions
    mine = [(i, [sum(w * x for w, x in zip(ws, xs)) for xs in zip(*base)]) for i in range(80) for ws in [[rng.random() for _ in base]]]
    monkeypatch.setattr(knn, "ANCHOR_BLOCK", anchors_in_a_block)
    monkeypatch.setattr(knn, "CORPUS_BLOCK", packed)
    monkeypatch.setattr(knn, "LEAST_PART", 20)
    asked = vectors(spark, mine).selectExpr("*", "id % 9 + 1 as k")
    assert got(knn.batch(asked, vectors(spark, corpus), 10)) == brute(mine, corpus, lambda i: i % 9 + 1)
    assert got(knn.batch(vectors(spark, corpus), vectors(spark, corpus), 80)) == brute(corpus, corpus, lambda i: 80)


def test_vectors_are_not_copied_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(knn, "ANCHOR_BLOCK", 2)
    rows = vectors(spark, [(i, [1.0, i + 1.0]) for i in range(9)])
    plan = knn.batch(rows, rows, 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_factors_give_the_matrix():
    rng = np.random.default_rng(1)
    flat = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 200))
    left, right = knn._factors(flat)
    assert left.shape == (300, 4) and np.abs(left @ right - flat).max() < 1e-11
    full = rng.normal(size=(300, 200))
    assert knn._factors(full)[0] is full


LOG = "id bigint, user_id bigint, article_id bigint, interaction_type string, read_time_seconds int, created_at timestamp_ntz"


@pytest.fixture(scope="module")
def world(spark):
    """30 articles, 6 users with five likes each, and a user of 40 pairs."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)]
    arts = [(i, f"T{i}", " ".join(rng.choices(words, k=9)), f"src{i % 3}", None, datetime(2024, 1, 1) + timedelta(days=i)) for i in range(30)]
    arts = storage.stored(spark.createDataFrame(arts, "id bigint, title string, summary string, source string, doi string, published_at timestamp_ntz"))
    emb = storage.stored(embed.hash_vectors(arts.select("id", F.col("summary").alias("text"))))
    log = [(u * 100 + k, u, (u * 7 + k * 3) % 30, "like", None, datetime(2024, 2, 1) + timedelta(hours=k)) for u in range(6) for k in range(5)]
    inter = storage.stored(listing.ranked_log(spark.createDataFrame(log, LOG)))
    pairs = storage.stored(spark.createDataFrame([(u, i) for u in range(7) for i in range(0, 30, 1 + u % 3)] + [(2, 77)], "user_id bigint, id bigint"))
    ents = storage.stored(spark.createDataFrame([(i, i % 4, f"e{i % 4}") for i in range(30)] + [(3, 9, "e9")], "article_id bigint, entity_id bigint, name string"))
    return pairs, arts, inter, emb, ents


def test_a_block_gets_each_vector_once_and_large_users_are_cut(spark, world, monkeypatch):
    pairs, _, _, emb, _ = world
    monkeypatch.setattr(blocks, "PAIR_BLOCK", 8)
    rows = blocks.gathered(pairs, "p")
    assert max(r.n for r in rows.select(F.size("p").alias("n")).collect()) < 30 and rows.select(F.explode("p")).count() == pairs.count()

    def run(left, right):
        return pa.table({"n": pa.array([len(left)], pa.int64()), "ids": pa.array([right.column("id").to_pylist()], pa.list_(pa.int64()))})

    for needed, least in ((1 << 16, 1 << 12), (20, 5)):
        monkeypatch.setattr(blocks, "NEEDED", needed)
        monkeypatch.setattr(blocks, "LEAST_NEEDED", least)
        found = blocks.with_vectors(rows, F.col("p.id"), emb, run, "n bigint, ids array<bigint>").collect()
        assert sum(r.n for r in found) == rows.count() and (len(found) > 1) == (least == 5)
        assert all(len(set(r.ids)) == len(r.ids) <= 30 for r in found)


def test_nearest_liked_and_products_are_those_of_single_pairs(spark, world):
    pairs, _, inter, emb, _ = world
    vec = {r.id: dict(zip(r.dims, r.ws)) for r in emb.collect()}
    dot = lambda x, y: sum(w * y.get(d, 0.0) for d, w in x.items())
    liked = {}
    for r in inter.collect():
        liked.setdefault(r.user_id, []).append(r.article_id)
    mine = {r.user_id: dict(zip(r.dims, r.ws)) for r in users.dense_vectors(inter, emb).collect()}
    told = feed.with_nearest_liked(pairs, inter, emb).collect()
    assert sorted((r.user_id, r.id) for r in told) == sorted((r.user_id, r.id) for r in pairs.collect())
    for r in told:
        best = min(((-round(dot(vec[r.id], vec[j]), 9), j) for j in liked.get(r.user_id, []) if r.id in vec), default=(0, None))
        assert (r.best, r.liked_id) == ((pytest.approx(-best[0], abs=2e-9), best[1]) if best[0] < 0 else (None, None))
    for r in ranking.with_products(pairs.withColumn("label", F.lit(1)), users.vectors(inter, emb), emb).collect():
        want = dot(mine[r.user_id], vec[r.id]) if r.user_id in mine and r.id in vec else None
        assert r.label == 1 and (r.s is None if want is None else abs(r.s - want) < 1e-12)


def test_signals_keep_a_pair_in_one_row(spark, world):
    pairs, *rest = world
    found = explain.signals(pairs, *rest, datetime(2024, 2, 1))
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.label for r in found.collect()} >= {"similar_to_interaction", "source_affinity", "topic_affinity", "freshness", "popularity", "shared_entities"}


def test_summaries_are_told_without_gathering_signals(spark, world):
    pairs, *rest = world
    as_of = datetime(2024, 2, 1)
    told = explain.explained(explain.signal_lists(pairs, *rest, as_of))
    want = explain.explanations(pairs, explain.signals(pairs, *rest, as_of))
    key = lambda df: sorted((r.user_id, r.id, r.summary, [tuple(s) for s in r.signals]) for r in df.collect())
    assert key(told) == key(want) and told.filter(F.size("signals") == 0).select("summary").distinct().collect()[0].summary == explain.NO_SIGNALS


def test_negatives_are_offered_as_many_places_as_can_be_taken(spark, world):
    _, arts, inter, emb, _ = world
    rows = ranking.reranker_pairs(inter, arts, emb, least=1, limit=5, pool=8).collect()
    newest = [r.id for r in arts.join(emb, "id", "left_semi").orderBy(F.desc("published_at"), "id").collect()]
    for u in range(6):
        good, bad = ({r.id for r in rows if r.user_id == u and r.label == x} for x in (1, 0))
        pool = [i for i in newest if i not in good][:8]
        order = sorted(pool, key=lambda i: (hashlib.sha256(f"42:{u}:{i}".encode()).hexdigest(), i))
        assert len(good) == 5 and bad == set(order[:5])
