from datetime import datetime, timedelta

import pytest

from presswork.plans.engine import Engine

NOW = datetime(2024, 1, 31)
GAZ = [{"name": "acme", "type": "company", "aliases": ["acme"]}, {"name": "drugamab", "type": "drug", "aliases": ["drugamab"]}]


def test_from_sources_to_feed(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), GAZ, NOW)
    said = "acme reports strong drugamab response in phase two"
    rows = [(said, f"http://{s}/1", s, "", NOW - timedelta(hours=i)) for i, s in enumerate("ABC")]
    rows = [(t + " " * i + "!" * i + (" today" if i == 1 else " again" if i == 2 else ""), *r) for i, (t, *r) in enumerate(rows)] + [("quite another matter", "http://D/1", "D", "", NOW - timedelta(days=1))]
    source = lambda s: s.createDataFrame(rows, "title string, url string, source string, summary string, published_at timestamp_ntz")

    def broken(s):
        raise OSError("down")

    first = engine.ingest({"good": source, "broken": broken}).first()
    assert (first.added_total, first.error_count, first.detail.embedded, first.detail.entities_extracted) == (4, 1, 4, 6)
    assert engine.ingest({"good": source}).first().added_total == 0
    ids = {r.source: r.id for r in engine.articles().collect()}
    assert len(ids) == 4 and engine.article(ids["A"]).first().url == "http://A/1"
    assert engine.search("quite another matter", 1).first().id == ids["D"]
    assert engine.related(ids["A"], 2).count() == 2
    assert {r.article_id for r in engine.detect_bursts().collect()} == {ids["A"], ids["B"], ids["C"]} and engine.detect_bursts().count() == 0
    assert "acme reports" in engine.burst_prompt(ids["A"]).first().prompt
    assert [r.name for r in engine.entities(q="CM").collect()] == ["acme"]
    acme = engine.entities("company").first().entity_id
    assert {r.predicate for r in engine.entity_relations(acme).collect()} == {"develops", "developed_by"}

    asked = spark.createDataFrame([("a@x", None, None), ("b@x", None, None)], "email string, apple_user_id string, google_user_id string")
    people = {r.email: r.id for r in engine.create_user(asked).collect()}
    assert people == {r.email: r.id for r in engine.create_user(asked).collect()} and None not in people.values()
    a, b = people["a@x"], people["b@x"]
    engine.record_interactions(spark.createDataFrame([(1, a, ids["A"], "like", NOW), (2, a, ids["D"], "hide", NOW)], "id bigint, user_id bigint, article_id bigint, interaction_type string, created_at timestamp_ntz"))
    got = engine.feed(limit=10).collect()
    assert {r.cold_start for r in got if r.user_id == a} == {False} and {r.cold_start for r in got if r.user_id == b} == {True}
    assert ids["D"] not in [r.id for r in got if r.user_id == a] and len([r for r in got if r.user_id == b]) == 4
    why = engine.explain(spark.createDataFrame([(a, ids["B"])], "user_id bigint, id bigint")).first()
    assert {s.label for s in why.signals} >= {"similar_to_interaction", "freshness", "shared_entities", "topic_affinity"}
    engine.delete_articles(spark.createDataFrame([(ids["A"],)], "id bigint"))
    assert engine.table("articles").count() == 3 and engine.table("events").count() == 2 and engine.interactions(a, "like").count() == 0
    assert not list(tmp_path.glob("*.old")) and not list(tmp_path.glob("*.new"))


def test_marks_batches_and_callers(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), GAZ, NOW)
    rows = [("acme drugamab", "u1", "A"), ("éé", "u2", "A"), ("nothing known", "u3", "B")]
    source = lambda s: s.createDataFrame([(t, u, n, "", NOW) for t, u, n in rows], "title string, url string, source string, summary string, published_at timestamp_ntz")
    first = engine.ingest({"x": source}).first()
    assert (first.detail.embedded, first.detail.entities_extracted) == (3, 2)
    assert engine.embed_missing() == 0 and engine.extract_missing() == 0  # texts without tokens or entities are marked too
    later = Engine(spark, str(tmp_path), GAZ, NOW + timedelta(days=1))
    asked = [("n@x", None, None), ("n@x", "ap", None), (None, "ap", "go"), (None, None, "go"), ("other@x", None, None)]
    people = later.create_user(spark.createDataFrame(asked, "email string, apple_user_id string, google_user_id string"))
    assert later.table("users").count() == 3
    ids = {(r.email, r.apple_user_id, r.google_user_id): r.id for r in people.collect()}
    assert ids["n@x", None, None] == ids["n@x", "ap", None] and ids[None, "ap", "go"] == ids[None, None, "go"] and None not in ids.values()
    a, b = ids["n@x", None, None], ids["other@x", None, None]
    art = {r.title: r.id for r in later.articles().collect()}
    acts = [(1, a, art["acme drugamab"], "like"), (2, b, art["nothing known"], "hide")]
    later.record_interactions(spark.createDataFrame([(*x, NOW) for x in acts], "id bigint, user_id bigint, article_id bigint, interaction_type string, created_at timestamp_ntz"))
    assert {r.user_id for r in later.user_vectors().collect()} == {a}
    later.record_interactions(spark.createDataFrame([(3, b, art["acme drugamab"], "read", 300, NOW)], "id bigint, user_id bigint, article_id bigint, interaction_type string, read_time_seconds int, created_at timestamp_ntz"))
    assert {r.user_id for r in later.user_vectors().collect()} == {a, b}
    me = later.as_user(a)
    assert {r.user_id for r in me.feed(limit=1).collect()} == {a} and me.feed(limit=1).first().next_cursor == 1 and me.feed(limit=10).first().next_cursor is None
    with pytest.raises(PermissionError):
        me.feed(user_ids=[b])
    with pytest.raises(PermissionError):
        me.interactions(b)
    assert {r.user_id for r in later.enhanced_feed(limit=2).collect()} >= {a, b}
    found = later.entity_relations(later.entities("company").first().entity_id).collect()
    assert {r.created_at for r in found} == {NOW}


def test_events_by_time_and_a_broken_off_replacement(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), [], NOW)
    event = lambda i, t: (i, "cross_source_burst", 1.0, [2], ["B"], 0.9, 48, 0.82, t)
    schema = "article_id bigint, kind string, score double, related_article_ids array<bigint>, related_sources array<string>, mean_similarity double, window_hours int, similarity_threshold double, detected_at timestamp_ntz"
    engine.append("events", spark.createDataFrame([event(1, NOW), event(5, NOW + timedelta(hours=1))], schema))
    assert [r.article_id for r in engine.events().collect()] == [5, 1]
    (tmp_path / "events").rename(tmp_path / "events.new")  # a crash between the two renames
    assert engine.table("events").count() == 2
    engine.delete_articles(spark.createDataFrame([(5,)], "id bigint"))
    assert [r.article_id for r in engine.events().collect()] == [1]
