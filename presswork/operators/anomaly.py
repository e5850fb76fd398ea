"""Cross-source bursts: much the same story in several sources at nearly the same time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import knn
from .embed import dense

KIND = "cross_source_burst"


def bursts(
    articles: DataFrame,
    embedded: DataFrame,
    recent: int | None = 100,
    k: int = 20,
    threshold: float = 0.82,
    hours: int = 48,
    least_sources: int = 2,
    existing: DataFrame | None = None,
) -> DataFrame:
    """(article_id, kind, score, related_article_ids, related_sources, mean_similarity,
    window_hours, similarity_threshold) of the latest fetched articles (all: recent=None).

    The k nearest are taken first; only then do other source, time and similarity count,
    so near copies from the same source can crowd others out. Events in `existing`
    (article_id, kind) are not made again.
    """
    vectors = dense(embedded)
    anchors = articles.join(embedded.select("id").distinct(), "id", "left_semi")
    if existing is not None:
        anchors = anchors.join(existing.filter(F.col("kind") == KIND).select(F.col("article_id").alias("id")), "id", "left_anti")
    if recent is not None:
        anchors = anchors.orderBy(F.desc_nulls_last("fetched_at"), "id").limit(recent)
    near = knn.batch(vectors.join(anchors.select("id"), "id", "left_semi"), vectors, k)
    facts = articles.select("id", "source", "published_at")
    a = facts.select(F.col("id").alias("anchor"), F.col("source").alias("a_source"), F.col("published_at").alias("a_time"))
    pairs = near.join(a, "anchor").join(facts, "id")
    apart = F.abs(F.unix_micros(F.col("published_at").cast("timestamp")) - F.unix_micros(F.col("a_time").cast("timestamp")))
    kept = pairs.filter((F.col("sim") >= threshold) & (F.col("source") != F.col("a_source")) & (apart <= hours * 3_600_000_000))
    return events(kept, threshold, hours, least_sources)


def events(kept: DataFrame, threshold: float, hours: int, least_sources: int = 2) -> DataFrame:
    """bursts() of the pairs that count: (anchor, id, sim, rn, source)."""
    found = kept.groupBy("anchor").agg(
        F.array_sort(F.collect_set("source")).alias("related_sources"),
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("related_article_ids"),
        F.avg("sim").alias("mean"),
        F.countDistinct("source").alias("n"),
    )
    return found.filter(F.col("n") >= least_sources).select(
        F.col("anchor").alias("article_id"),
        F.lit(KIND).alias("kind"),
        F.round(F.col("mean") * F.col("n"), 4).alias("score"),
        "related_article_ids",
        "related_sources",
        F.round("mean", 4).alias("mean_similarity"),
        F.lit(hours).alias("window_hours"),
        F.lit(threshold).alias("similarity_threshold"),
    )


def evidence(events: DataFrame, articles: DataFrame) -> DataFrame:
    """events with `related`: the related articles' (source, title) in the listed order;
    articles that are gone are left out."""
    listed = events.select("article_id", F.posexplode("related_article_ids").alias("pos", "id"))
    rows = listed.join(articles.select("id", "source", "title"), "id")
    gathered = rows.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "title"))).alias("related"))
    return events.join(gathered, "article_id", "left")


def prompts(events: DataFrame, articles: DataFrame) -> DataFrame:
    """(article_id, prompt): what a model is told to explain an event by: the article,
    the detector's figures and the related coverage."""
    full = evidence(events, articles).join(articles.select(F.col("id").alias("article_id"), "source", "title", "summary"), "article_id")
    lines = F.array_join(F.transform("related", lambda r: F.concat(F.lit("- ["), r["source"], F.lit("] "), r["title"])), "\n")
    text = F.concat_ws(
        "\n",
        F.lit("Explain in two or three sentences why this article may be an early signal. Use only the evidence below."),
        F.concat(F.lit("Article ("), F.col("source"), F.lit("): "), F.col("title")),
        F.concat(F.lit("Summary: "), F.coalesce(F.nullif("summary", F.lit("")), F.lit("(none)"))),
        F.concat(F.lit("Detector: "), F.col("kind"), F.lit(", score "), F.format_number("score", 4)),
        F.concat(
            F.size("related_sources").cast("string"),
            F.lit(" independent sources within "),
            F.col("window_hours").cast("string"),
            F.lit(" hours, mean similarity "),
            F.format_number("mean_similarity", 4),
        ),
        F.concat(F.lit("Coverage:\n"), F.coalesce(F.nullif(lines, F.lit("")), F.lit("(none)"))),
    )
    return full.select("article_id", text.alias("prompt"))
