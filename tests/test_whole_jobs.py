"""Registered queries on small tables whose ids lie beyond any fixed range."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from presswork import catalogue
from presswork.operators import embed, feed, knn, listing, ranking, users
from presswork.sources import adapters as A

KINDS = ["view", "purchase", "click", "error", "search"]
USERS = [3, 25, 70, 900]
DOCS = list(range(40)) + [130, 5000]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top, rng = str(tmp_path_factory.mktemp("tables")), random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["attion", "queoi"]
    docs = [(i, f"Head {i}\n" + " ".join(rng.choices(words, k=12)), "en", f"src{i % 4}", 50) for i in DOCS[:-1]] + [(DOCS[-1], "Head\nattion of queoi", "en", "src1", 20)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{top}/documents.parquet")
    events = []
    for u in USERS:
        for k in range(40):
            article = DOCS[-1] if k == 0 else rng.choice(DOCS)
            events.append((len(events), datetime(2024, 1, 1) + timedelta(minutes=k * 7 + u), u, KINDS[k % 5], float(rng.randrange(1, 400)), json.dumps({"k": article})))
    spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{top}/events.parquet")
    vectors = [(i * 50 + 1, [rng.gauss(i % 3 == d, 0.5) for d in range(768)], i % 3) for i in range(130)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    return top


def brute_feed(inter, emb, limit):
    """{user: ids} by plain loops over the vectors."""
    gone = {(r.user_id, r.article_id) for r in listing.hidden(inter).collect()}
    items, mine = {}, {}
    for r in embed.sparse(emb).collect():
        items.setdefault(r.id, {})[r.dim] = r.w
    for r in users.vectors(inter, emb).collect():
        mine.setdefault(r.user_id, {})[r.dim] = r.w
    sim = lambda u, i: round(sum(w * items[i].get(d, 0) for d, w in mine[u].items()), 9)
    return {u: sorted((i for i in items if (u, i) not in gone), key=lambda i: (-sim(u, i), i))[:limit] for u in mine}


def test_every_user_gets_the_brute_force_feed(spark, tables):
    want = brute_feed(A.interactions(spark, tables), catalogue._embedded(spark, tables), 10)
    assert set(want) == set(USERS)
    got = {}
    for r in catalogue.feed_warm(spark, tables).orderBy("rn").collect():
        got.setdefault(r.user_id, []).append(r.id)
    assert got == want


def test_more_users_than_a_block_rank_articles_without_shared_words_too(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha gamma")], "id bigint, text string")
    emb = embed.hash_embedding(texts)
    rows = [(u, u, 1, "like", None, datetime(2024, 1, 1)) for u in range(5)]
    inter = spark.createDataFrame(rows, "id bigint, user_id bigint, article_id bigint, interaction_type string, read_time_seconds int, created_at timestamp_ntz")
    monkeypatch.setattr(knn, "ANCHOR_BLOCK", 2)
    got = {}
    for r in feed.warm(users.vectors(inter, emb), inter, emb, limit=3).orderBy("rn").collect():
        got.setdefault(r.user_id, []).append(r.id)
    assert got == {u: [1, 3, 2] for u in range(5)}


def test_entities_of_every_article(spark, tables):
    got = {(r.article_id, r.name) for r in catalogue.kg_article_entities(spark, tables).collect()}
    texts = {r.doc_id: r.text.split() for r in A.table(spark, tables, "documents").collect()}
    assert got == {(i, name) for i, words in texts.items() for name in ("attion", "queoi") if name in words} and (5000, "attion") in got


def test_every_vector_is_evaluated(spark, tables):
    rows = A.table(spark, tables, "embeddings").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits, ndcg = [], []
    for i, sims in enumerate(np.round(x @ x.T, 9)):
        near = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-sims[j], j))[:10]
        good = [rows[j].label == rows[i].label for j in near]
        hits.append(any(good))
        n = min(10, sum(r.label == rows[i].label for r in rows) - 1)
        ndcg.append(sum(g / math.log2(k + 2) for k, g in enumerate(good)) / sum(1 / math.log2(k + 2) for k in range(n)))
    got = catalogue.knn_labels_recall_ndcg(spark, tables).first()
    assert got.n_queries == len(rows) == 130
    assert got.hit_rate_at_10 == pytest.approx(np.mean(hits), abs=1e-4) and got.ndcg_at_10 == pytest.approx(np.mean(ndcg), abs=1e-4)


def test_pairs_are_every_users_candidates_and_interactions(spark, tables):
    inter = A.interactions(spark, tables)
    feeds = brute_feed(inter, catalogue._embedded(spark, tables), 100)
    want = {(u, i) for u, ids in feeds.items() for i in ids} | {(r.user_id, r.article_id) for r in inter.collect()}
    assert {u for u, _ in want} == set(USERS) and {i for _, i in want} == set(DOCS)
    for rows in (catalogue.ranker_features(spark, tables), catalogue.explain_summaries(spark, tables)):
        got = [(r.user_id, r.id) for r in rows.collect()]
        assert len(got) == len(want) and set(got) == want
    assert {r.user_id for r in catalogue.explain_signals(spark, tables).collect()} == set(USERS)


def test_enhanced_feed_trains_on_and_serves_everyone(spark, tables, monkeypatch):
    seen = {}

    def train(rows, **settings):
        seen.update(settings, users={r.user_id for r in rows.collect()}, popularity={r.id: r.popularity for r in rows.collect()})

    monkeypatch.setattr(ranking, "train_gbt", train)  # without a model the order is the similarity's
    inter = A.interactions(spark, tables)
    got = {}
    for r in catalogue.feed_enhanced(spark, tables).orderBy("rn").collect():
        got.setdefault(r.user_id, []).append(r.id)
    assert got == brute_feed(inter, catalogue._embedded(spark, tables), 10) and set(got) == set(USERS)
    assert seen["users"] == set(USERS) and (seen["rounds"], seen["depth"], seen["rate"]) == (500, 6, 0.05)
    counts = {r.article_id: r.popularity for r in users.popularity(inter).collect()}
    assert seen["popularity"] == {i: counts.get(i, 0) for i in seen["popularity"]}


def test_first_lines_that_differ_late_are_no_copies(spark, tmp_path):
    line = "the same words " * 20
    docs = [(i, line + end + "\nmore", "en", "s", 1) for i, end in enumerate(["one", "two", "ONE!"])]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.id for r in catalogue.dedup_title_hash(spark, str(tmp_path)).collect()) == [0, 1]
    assert sorted(r.id for r in catalogue.dedup_three_tier(spark, str(tmp_path)).collect()) == [0, 1]
    assert [(r.added, r.duplicates) for r in catalogue.ingest_counts_by_source(spark, str(tmp_path)).collect()] == [(2, 1)]
