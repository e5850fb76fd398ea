import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from presswork.functions import dates as D
from presswork.functions import scores as S
from presswork.functions import text as T


def one(spark, expression, *rows, schema="a string, b string, c string"):
    data = [tuple(r) + (None,) * (3 - len(r)) for r in rows]
    return [r[0] for r in spark.createDataFrame(data, schema).select(expression).collect()]


def test_titles_that_differ_in_case_and_punctuation_are_equal(spark):
    got = one(spark, T.normalize_title(F.col("a")), ["A New  Drug: phase-2!"], ["a new drug phase 2"], ["éé"], [None])
    assert got == ["a new drug phase 2", "a new drug phase 2", "", None]


def test_content_hash(spark):
    assert one(spark, T.content_hash(F.col("a")), ["Same!"]) == [hashlib.sha256(b"same").hexdigest()]


def test_embedding_text_leaves_out_an_empty_summary(spark):
    got = one(spark, T.embedding_text(F.col("a"), F.col("b"), 10), ["title", "summary"], ["title", ""], ["title"])
    assert got == ["title. sum", "title", "title"]


def test_nct_ids_keep_the_order_of_first_mention(spark):
    assert one(spark, T.nct_ids(F.col("a")), ["NCT00000002 x NCT00000001, NCT00000002 NCT123 nct00000003 NCT000000045"]) == [["NCT00000002", "NCT00000001"]]


def test_feed_text_resolves_entities_twice_and_abstracts_keep_escaped_tags():
    assert T.feed_markup_to_text("<p>A &amp;amp; B</p> <b>c</b>") == "A & B c"
    assert T.feed_markup_to_text("  ") is None and T.feed_markup_to_text(None) is None
    assert T.abstract_markup_to_text("x <i>y</i> &lt;b&gt;") == "x y <b>"
    assert T.abstract_markup_to_text("") is None


def test_pub_dates(spark):
    got = one(spark, D.parse_pub_date(F.col("a"), F.col("b"), F.col("c")), ["2024", "March", "5"], ["2024", "03", None], ["2024", None, None], [None, "Jan", "1"], ["2024", "Feb", "31"])
    assert got == [datetime(2024, 3, 5), datetime(2024, 1, 1), datetime(2024, 1, 1), None, None]


def test_feed_dates_are_utc(spark):
    got = one(spark, D.parse_feed_date(F.col("a"), F.col("b")), ["Tue, 02 Jan 2024 03:04:05 GMT"], ["Tue, 02 Jan 2024 03:04:05 +0200"], ["x", "Wed, 3 Jan 2024 00:00:00 GMT"])
    assert got == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 1, 4, 5), datetime(2024, 1, 3)]


def test_freshness_is_capped_and_may_be_negative(spark):
    as_of = datetime(2024, 1, 31)
    got = one(spark, D.freshness_days(F.col("a").cast("timestamp_ntz"), as_of), ["2024-01-30 12:00:00"], ["2024-02-01 12:00:00"], ["2000-01-01"], [None])
    assert got == [0.0, -2.0, 365.0, 365.0]


def test_source_quality(spark):
    got = one(spark, S.source_quality(F.col("a")), ["Nature"], ["Immunity"], ["GEN"], ["Biorxiv (x)"], ["PubMed"], ["blog"])
    assert got == [1.0, 0.9, 0.7, 0.6, 0.5, 0.3]
    assert one(spark, S.source_quality(F.col("a"), any_case=False), ["Biorxiv (x)"]) == [0.3]


def test_cosine_of_a_zero_vector_is_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [round(r[0], 6) for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [0.707107, 0.0]
