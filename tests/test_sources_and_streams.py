import json
from datetime import datetime

import pytest

from presswork.operators import evaluate, ingest, kg
from presswork.sources import feeds, synthetic
from presswork.streaming.ingest import ingest_stream

FEED = """<?xml version="1.0"?><rss version="2.0"><channel><title>f</title>
<item><title>First &amp;lt;b&amp;gt;bold&amp;lt;/b&amp;gt; story</title><link>https://a/1</link><description>&lt;p&gt;Some &amp;amp; text&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>
<item><title>No link</title></item></channel></rss>"""
RECORDS = """<PubmedArticleSet><PubmedArticle><PMID>7</PMID><ArticleTitle>A <i>B</i> C</ArticleTitle><Abstract><AbstractText Label="AIM">x <b>y</b></AbstractText><AbstractText>z</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName></Author><Author><LastName>Roe</LastName><Initials>R</Initials></Author></AuthorList>
<ArticleId IdType="doi">10.1/x</ArticleId><Journal><JournalIssue><PubDate><Year>2024</Year><Month>Feb</Month></PubDate></JournalIssue></Journal></PubmedArticle>
<PubmedArticle><PMID>8</PMID></PubmedArticle></PubmedArticleSet>"""


def test_feeds_and_error_isolation(spark, tmp_path):
    (tmp_path / "good.xml").write_text(FEED)
    (tmp_path / "bad.xml").write_text("<rss><channel>")
    frame, errors = ingest.read_sources({"good": lambda s: feeds.rss(s, str(tmp_path / "good.xml"), "good"), "bad": lambda s: feeds.rss(s, str(tmp_path / "bad.xml"), "bad")}, spark)
    (row,) = frame.collect()
    assert (row.url, row.source, row.summary, row.published_at) == ("https://a/1", "good", "Some & text", datetime(2024, 1, 2, 3, 4, 5))
    assert list(errors) == ["bad"]


def test_pubmed_keeps_mixed_content_in_order(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RECORDS)
    (tmp_path / "b.xml").write_text("<broken")
    with pytest.raises(Exception, match="b.xml"):
        feeds.pubmed(spark, str(tmp_path)).collect()
    assert [r.file.rsplit("/", 1)[1] for r in feeds.broken_files(spark, str(tmp_path)).collect()] == ["b.xml"]
    (row,) = feeds.pubmed(spark, str(tmp_path), strict=False).collect()
    assert (row.title, row.summary, row.authors, row.doi) == ("A B C", "AIM: x y z", "Jo Doe; R Roe", "10.1/x")
    assert row.external_id == "pmid:7" and row.published_at == datetime(2024, 2, 1)


def test_preprints(spark, tmp_path):
    page = {"collection": [{"doi": "10.1101/1", "title": "T", "abstract": "<p>A</p>", "authors": "A, B.; C, D.", "date": "2024-01-05", "category": "Genomics", "version": "2"}, {"doi": "10.1101/2", "title": ""}, {"doi": "10.1101/3", "title": "U", "category": "botany", "version": "x", "date": "?"}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    rows = {r.doi: r for r in feeds.preprints(spark, str(tmp_path)).collect()}
    assert rows["10.1101/1"].url.endswith("/10.1101/1v2") and rows["10.1101/1"].authors == "A, B.; C, D." and rows["10.1101/1"].source == "Biorxiv (Genomics)"
    assert rows["10.1101/3"].url.endswith("/10.1101/3") and rows["10.1101/3"].published_at is None and len(rows) == 2
    assert [r.doi for r in feeds.preprints(spark, str(tmp_path), categories=["genomics"]).collect()] == ["10.1101/1"]


def test_the_first_preprints_by_place_and_the_default_subjects(spark, tmp_path):
    page = {"collection": [{"doi": f"10.1101/{9 - i}", "title": "T", "category": c} for i, c in enumerate(feeds.CATEGORIES + ["botany"])]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    assert [r.doi for r in feeds.preprints(spark, str(tmp_path), limit=2).collect()] == ["10.1101/9", "10.1101/8"]
    assert feeds.preprints(spark, str(tmp_path), categories=feeds.CATEGORIES).count() == 14


def test_trials_dictionary_and_labelled_searches(spark, tmp_path):
    for name, data in (
        ("t/1.json", {"protocolSection": {"identificationModule": {"nctId": "NCT00000001", "briefTitle": "A trial"}}}),
        ("t/2.json", {"protocolSection": {"identificationModule": {"nctId": "NCT00000002"}}}),
        ("g.json", {"entities": [{"name": "b", "type": "drug", "aliases": ["b", "bb"]}, {"name": "a", "type": "gene", "external_id": "X", "aliases": ["a"]}]}),
        ("l.json", {"corpus": [{"id": 1, "title": "alpha", "summary": "x", "source": "s"}], "queries": [{"query": "alpha", "relevant_ids": [1]}]}),
    ):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(data, indent=1))
    assert [tuple(r) for r in feeds.trials(spark, str(tmp_path / "t")).collect()] == [("NCT00000001", "A trial")]
    words = feeds.gazetteer(spark, str(tmp_path / "g.json"))
    assert [(w["name"], w["external_id"], w["aliases"]) for w in words] == [("b", None, ["b", "bb"]), ("a", "X", ["a"])]
    df = spark.createDataFrame([(1, "bb and a")], "id bigint, text string")
    assert [(r.entity, r.mention_text) for r in kg.mentions(df, words).orderBy("pos").collect()] == [(0, "bb"), (1, "a")]
    articles, queries = feeds.labelled_set(spark, str(tmp_path / "l.json"))
    assert evaluate.search_quality(articles, queries).first().ndcg_at_10 == 1.0


def test_made_up_articles_and_users(spark):
    made = synthetic.articles(spark, count=60)
    found = made.orderBy("id").collect()
    assert [r.id for r in found] == list(range(60)) and {r.topic for r in found} == {f"topic {i}" for i in range(10)}
    words = {}
    for r in found:
        words.setdefault(r.topic, set()).update(r.summary.split())
        assert len(r.summary.split()) == 30 and len(r.title.split()) == 6
    assert len(words["topic 0"] & words["topic 1"]) < 0.6 * len(words["topic 0"])
    inter = synthetic.interactions(made, 25, datetime(2024, 1, 31)).collect()
    assert {r.user_id for r in inter} == set(range(25)) and len({r.id for r in inter}) == len(inter)
    mine = [r for r in inter if r.user_id == 7]
    assert sum(r.interaction_type == "hide" for r in mine) == 3 and len(mine) == 6 + 5 + 3  # a topic has six articles
    assert {r.article_id % 10 for r in mine if r.interaction_type in ("like", "bookmark")} == {7}
    assert all((r.read_time_seconds is not None) == (r.interaction_type == "read") for r in inter)
    assert sorted(map(tuple, inter)) == sorted(map(tuple, synthetic.interactions(made, 25, datetime(2024, 1, 31)).collect()))


def rows(spark, *numbers):
    return spark.createDataFrame([(i, f"u{i % 3}", None, f"h{i}", f"s{i % 2}") for i in numbers], "id bigint, url string, doi string, content_hash string, source string")


def test_stream_stores_each_article_once(spark, tmp_path):
    rows(spark, 0, 1, 3).write.parquet(str(tmp_path / "in"))
    seen, failed = [], []

    def bad(df, number):
        raise RuntimeError("stage")

    def go():
        stream = spark.readStream.schema(rows(spark, 0).schema).parquet(str(tmp_path / "in"))
        ingest_stream(stream, str(tmp_path / "store"), str(tmp_path / "ck"), {"bad": bad, "count": lambda df, n: seen.append(df.count())}, lambda name, n, e: failed.append(name)).awaitTermination()

    go()
    rows(spark, 4, 5).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    stored = spark.read.parquet(str(tmp_path / "store")).select("id").collect()
    assert sorted(r.id for r in stored) == [0, 1, 5] and seen == [2, 1] and failed == ["bad", "bad"]


def test_run_record(spark):
    counts = ingest.counts(ingest.created(rows(spark, 0, 1, 3)))
    row = ingest.run_record(spark, counts, {"x": "down"}, datetime(2024, 1, 1), datetime(2024, 1, 1)).first()
    assert row.added_total == 2 and row.error_count == 1 and row.detail.errors == {"x": "down"}
