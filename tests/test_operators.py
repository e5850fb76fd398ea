import hashlib
import math
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.operators import anomaly, dedup, embed, evaluate, explain, feed, ingest, kg, knn, listing, ranking, users

ART = "id bigint, title string, url string, source string, summary string, doi string, content_hash string, published_at timestamp_ntz, fetched_at timestamp_ntz"
INTER = "id bigint, user_id bigint, article_id bigint, interaction_type string, read_time_seconds int, created_at timestamp_ntz"
NOW = datetime(2024, 1, 31)


def articles(spark, rows):
    full = [(i, t, f"u{i}", s, "", None, hashlib.sha256(t.lower().encode()).hexdigest(), p, NOW) for i, t, s, p in rows]
    return spark.createDataFrame(full, ART)


def embedded(spark, arts):
    return embed.hash_embedding(arts.select("id", F.col("title").alias("text")))


def reference_vector(text):
    v = [0.0] * 768
    for token in re.findall("[a-z0-9]+", text.lower()):
        h = hashlib.sha256(token.encode()).digest()
        v[int.from_bytes(h[:4], "big") % 768] += 1.0 if h[4] % 2 == 0 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return {i: x / n for i, x in enumerate(v) if x}


def test_hash_embedding_equals_a_plain_loop(spark):
    texts = ["Gene therapy, gene editing 2024", "", "é only", "a a a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {}
    for r in embed.hash_embedding(df).collect():
        got.setdefault(r.id, {})[r.dim] = r.w
    for i, text in enumerate(texts):
        want = reference_vector(text) if re.search("[a-z0-9]", text.lower()) else {}
        assert got.get(i, {}) == pytest.approx(want)


def sequential(rows):
    seen, kept = set(), []
    for i, *keys in rows:
        mine = {(k, v) for k, v in enumerate(keys) if v is not None}
        if not mine & seen:
            seen |= mine
            kept.append(i)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_three_tier_dedup_equals_the_sequential_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"u{rng.randrange(60)}", f"d{rng.randrange(40)}" if rng.random() < 0.5 else None, f"h{rng.randrange(50)}") for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, url string, doi string, content_hash string")
    assert sorted(r.id for r in dedup.three_tier(df).select("id").collect()) == sequential(rows)


def test_dropped_rows_keys_do_not_count_and_history_does(spark):
    rows = [(1, "a", "d", "x"), (2, "b", "d", "t"), (3, "c", None, "t")]
    df = spark.createDataFrame(rows, "id bigint, url string, doi string, content_hash string")
    assert sorted(r.id for r in dedup.three_tier(df).collect()) == [1, 3]
    assert [r.id for r in dedup.three_tier(df.filter("id > 1"), history=df.filter("id = 1")).collect()] == [3]
    assert dedup.three_tier(df.limit(0)).count() == 0


def interactions(spark):
    t = lambda h: NOW - timedelta(hours=h)
    rows = [(1, 1, 10, "read", 300, t(5)), (2, 1, 11, "read", 150, t(4)), (3, 1, 12, "bookmark", None, t(3)), (4, 1, 13, "hide", None, t(2)), (5, 1, 10, "search", None, t(1)), (6, 2, 10, "read", 0, t(1))]
    return spark.createDataFrame(rows, INTER)


def test_user_weights_vector_and_stats(spark):
    arts = articles(spark, [(i, f"word{i} common", "s", NOW) for i in range(10, 15)])
    inter = interactions(spark)
    assert {(r.user_id, r.article_id): r.weight for r in users.weights(inter).collect()} == {(1, 10): 1.0, (1, 11): 0.5, (1, 12): 1.0, (2, 10): 0.0}
    v = users.vectors(inter, embedded(spark, arts)).collect()
    assert {r.user_id for r in v} == {1} and sum(r.w**2 for r in v) == pytest.approx(1) and v[0].interaction_count == 3
    s = {r.user_id: r for r in users.stats(inter).collect()}
    assert s[1].interaction_count == 5 and s[1].avg_read_time == 225 and s[1].bookmark_rate == 0.2 and s[2].avg_read_time == 0
    assert {r.article_id for r in listing.hidden(inter).collect()} == {13}
    assert {r.article_id: r.popularity for r in users.popularity(inter).collect()} == {10: 3, 11: 1, 12: 1, 13: 1}


def test_affinities_are_shares_of_distinct_articles(spark):
    arts = articles(spark, [(10, "x", "A", NOW), (11, "y", "B", NOW), (12, "z", "A", NOW)])
    got = {(r.user_id, r.source): r.share for r in users.source_affinity(interactions(spark), arts).collect()}
    assert got == {(1, "A"): pytest.approx(2 / 3), (1, "B"): pytest.approx(1 / 3), (2, "A"): 1.0}


def test_feeds_leave_out_hidden_articles(spark):
    arts = articles(spark, [(i, f"word{i} common", "s", NOW - timedelta(days=i)) for i in range(10, 15)] + [(50, "old common", "s", datetime(2020, 1, 1))])
    emb, inter = embedded(spark, arts), interactions(spark)
    cold = feed.cold(arts, inter, emb, inter.select("user_id"), NOW, limit=3).filter("user_id = 1").orderBy("rn").collect()
    assert [r.id for r in cold] == [10, 11, 12] and cold[0].reason == feed.COLD_REASON
    assert [r.id for r in feed.cold(arts, inter, emb, inter.select("user_id"), NOW, limit=3, offset=2).filter("user_id = 1").orderBy("rn").collect()] == [12, 14]
    warm = feed.with_reasons(feed.warm(users.vectors(inter, emb), inter, emb, limit=10), arts, inter, emb).orderBy("rn").collect()
    assert 13 not in [r.id for r in warm]
    assert next(r for r in warm if r.id == 12).reason == "Similar to article you bookmarked: word12 common..."


GAZ = [
    {"name": "sickle disease", "type": "disease", "external_id": "X1", "aliases": ["sickle disease", "SCD"]},
    {"name": "disease", "type": "disease", "aliases": ["disease"]},
    {"name": "acme", "type": "company", "aliases": ["Acme Bio", "acme"]},
    {"name": "drugamab", "type": "drug", "aliases": ["drugamab"]},
]


def found(spark, text):
    df = spark.createDataFrame([(1, text)], "id bigint, text string")
    return [(r.entity, r.mention_text) for r in kg.mentions(df, GAZ).orderBy("pos").collect()]


def test_longest_alias_claims_first_and_later_occurrences_are_not_tried(spark):
    assert found(spark, "Sickle Disease by ACME bio") == [(0, "Sickle Disease"), (2, "ACME bio")]
    assert found(spark, "sickle disease, then disease") == [(0, "sickle disease")]
    assert found(spark, "éacme acmeé diseases") == []


def test_relations_by_type(spark):
    df = spark.createDataFrame([(1, "drugamab of acme for scd")], "id bigint, text string")
    ents = kg.article_entities(kg.mentions(df, GAZ), kg.gazetteer_table(spark, GAZ))
    name = {r.entity_id: r.name for r in ents.collect()}
    edges = {(name[r.subject_entity_id], r.predicate, name[r.object_entity_id]) for r in kg.relations(ents).collect()}
    assert ("acme", "develops", "drugamab") in edges and ("drugamab", "developed_by", "acme") in edges
    assert ("drugamab", "targets", "sickle disease") in edges and len(edges) == 6
    crossed = {(name[r.subject_entity_id], r.predicate, name[r.object_entity_id]) for r in kg.relations(ents, directed=False).collect()}
    assert ("drugamab", "develops", "acme") in crossed


def test_unknown_trials_leave_no_entity(spark):
    df = spark.createDataFrame([(1, "NCT00000001 NCT00000002")], "id bigint, text string")
    trials = spark.createDataFrame([("NCT00000001", "A trial"), ("NCT00000002", None)], "nct_id string, title string")
    assert [(r.name, r.external_id) for r in kg.trial_mentions(df, trials).collect()] == [("A trial", "NCT00000001")]


def test_bursts_need_two_other_sources_near_in_time(spark):
    t = datetime(2024, 1, 10)
    same = "new drug shows strong response in phase two study"
    arts = articles(spark, [(1, same, "A", t), (2, same + " today", "B", t + timedelta(hours=2)), (3, same, "C", t + timedelta(hours=10)), (4, "quite other words here", "A", t)])
    emb = embedded(spark, arts)
    got = {r.article_id: r for r in anomaly.bursts(arts, emb).collect()}
    assert set(got) == {1, 2, 3} and got[1].related_sources == ["B", "C"]
    assert anomaly.bursts(arts, emb, existing=anomaly.bursts(arts, emb)).count() == 0
    far = articles(spark, [(1, same, "A", t), (2, same, "B", t + timedelta(days=10)), (3, same, "C", t - timedelta(days=10))])
    assert anomaly.bursts(far, embedded(spark, far)).count() == 0
    text = anomaly.prompts(anomaly.bursts(arts, emb).filter("article_id = 1"), arts).first().prompt
    assert "- [C] " + same in text and "2 independent sources within 48 hours" in text


def test_nearest_first_then_other_filters(spark):
    t = datetime(2024, 1, 10)
    rows = [(1, "same words here", "A", t)] + [(i, "same words here", "A", t) for i in range(2, 6)] + [(i, "same words here now", s, t) for i, s in ((10, "B"), (11, "C"))]
    arts = articles(spark, rows)
    emb = embedded(spark, arts)
    assert 1 not in {r.article_id for r in anomaly.bursts(arts, emb, k=4).collect()}
    assert 1 in {r.article_id for r in anomaly.bursts(arts, emb, k=20).collect()}


def test_search_and_related(spark):
    arts = articles(spark, [(1, "alpha beta", "s", NOW), (2, "alpha beta gamma", "s", NOW), (3, "delta", "s", NOW)])
    emb = embedded(spark, arts)
    got = knn.search("alpha beta", arts, emb, 3).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2, 3] and got[0].similarity == 1.0 and got[2].similarity == 0.0
    assert [r.id for r in knn.related(1, arts, emb, 5).orderBy("rank").collect()] == [2, 3]
    with pytest.raises(ValueError):
        listing.articles(arts, limit=500)


def test_evaluation_figures(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1), (2, 13, 6)], "query bigint, id bigint, rank int")
    truth = spark.createDataFrame([(1, 11), (2, 13)], "query bigint, id bigint")
    r = evaluate.retrieval(ranked, truth).first()
    assert (r.n_queries, r.hit_rate_at_5, r.hit_rate_at_10) == (2, 0.5, 1.0)
    assert r.ndcg_at_10 == pytest.approx((1 / math.log2(3) + 1 / math.log2(7)) / 2, abs=1e-4)
    p = evaluate.percentiles(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double"), "v").first()
    assert p.p50 == 2.5


def test_explanations_are_ordered_and_have_a_fallback(spark):
    arts = articles(spark, [(i, f"word{i} common", "Nature" if i == 14 else "blog", NOW - timedelta(days=100)) for i in range(10, 15)] + [(60, "zzz", "other", datetime(2020, 1, 1))])
    emb, inter = embedded(spark, arts), interactions(spark)
    none = spark.createDataFrame([], "article_id bigint, entity_id bigint, name string")
    pairs = spark.createDataFrame([(1, 14), (3, 60)], "user_id bigint, id bigint")
    rows = {r.id: r for r in explain.explanations(pairs, explain.signals(pairs, arts, inter, emb, none, NOW)).collect()}
    weights = [s.weight for s in rows[14].signals]
    assert weights == sorted(weights, reverse=True) and rows[14].signals[0].label == "source_quality"
    assert rows[60].summary == explain.NO_SIGNALS and rows[60].signals == []


def test_training_sets_and_models(spark):
    arts = articles(spark, [(i, f"word{i} topic{i % 3}", f"s{i % 4}", NOW - timedelta(hours=i)) for i in range(60)])
    emb = embedded(spark, arts)
    rows = [(u * 100 + k, u, (u * 7 + k * 3) % 60, ["read", "like", "bookmark"][k % 3], 100, NOW - timedelta(hours=k)) for u in range(6) for k in range(12)]
    inter = spark.createDataFrame(rows, INTER)
    pairs = ranking.reranker_pairs(inter, arts, emb)
    counts = {r.label: r.n for r in ranking.label_counts(pairs).collect()}
    assert counts[0] == counts[1] > 0
    none = spark.createDataFrame([], "article_id bigint, entity_id bigint, name string")
    data = ranking.features(ranking.split(pairs, ["user_id", "id"]), arts, inter, emb, none, NOW)
    assert [c for c in data.columns if c in ranking.FEATURES] == ranking.FEATURES and data.count() == sum(counts.values())
    tower = ranking.TwoTower(768, (32,), 8)
    x = np.eye(768)[np.random.default_rng(0).integers(0, 768, 64)]
    losses = tower.fit(x, x, epochs=5, batch=32, rate=0.01)
    assert losses[-1] < losses[0]
    vectors = tower.embed(embed.dense(emb)).first().embedding
    assert sum(v * v for v in vectors) == pytest.approx(1)
    near = feed.by_tower(users.vectors(inter, emb), inter, emb, tower, 5).collect()
    assert {r.user_id for r in near} == set(range(6)) and len(near) == 30


def test_tower_gradients_equal_differences():
    rng = np.random.default_rng(1)
    tower = ranking.Tower([5, 4, 3], 0.0, rng)
    x, g = rng.normal(size=(6, 5)), rng.normal(size=(6, 3))
    tower.forward(x, True)
    for p, d in zip(tower.parameters(), tower.backward(g)):
        at = tuple(rng.integers(0, n) for n in p.shape)
        sums = []
        for e in (1e-6, -1e-6):
            p[at] += e
            sums.append((tower.forward(x, True) * g).sum())
            p[at] -= e
        assert d[at] == pytest.approx((sums[0] - sums[1]) / 2e-6, abs=1e-5)


def test_search_quality_and_cursor_of_ties(spark):
    arts = spark.createDataFrame([(1, "alpha beta", None, "s"), (2, "gamma", "delta", "s"), (3, "alpha", "", "s")], "id bigint, title string, summary string, source string")
    asked = spark.createDataFrame([(0, "alpha beta", [1]), (1, "delta", [2, 3])], "query bigint, text string, relevant array<bigint>")
    r = evaluate.search_quality(arts, asked).first()
    assert (r.n_queries, r.hit_rate_at_5) == (2, 1.0)


def test_model_embedder_in_batches(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], "id bigint, text string")
    got = {r.id: (r.dims, r.ws) for r in embed.model_embedder(lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts], batch=2)(df).collect()}
    assert got == {1: ([0, 1], [0.6, 0.8]), 3: ([0, 1], [0.6, 0.8])}


def test_users_and_cascades(spark):
    known = spark.createDataFrame([(1, "a@x", None, None), (2, None, "ap", None)], "id bigint, email string, apple_user_id string, google_user_id string")
    asked = spark.createDataFrame([(0, "a@x", "ap", None), (1, None, "ap", None), (2, "new@x", None, None)], "n int, email string, apple_user_id string, google_user_id string")
    assert {r.n: r.id for r in users.get_or_create(known, asked).collect()} == {0: 1, 1: 2, 2: None}
    kids = spark.createDataFrame([(1, 5), (2, 6)], "k int, parent bigint")
    assert [r.k for r in ingest.surviving(kids, spark.createDataFrame([(5,)], "id bigint"), "parent").collect()] == [1]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string"), spark.createDataFrame([(2, "c")], "id bigint, v string")
    assert {r.id: r.v for r in users.upsert(old, new, "id").collect()} == {1: "a", 2: "c"}
