"""The driver's tables as articles and interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream. A table of one file is read through its folder, as
    file streams take folders only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_of(table(spark, sf_dir, "documents"))


def articles_of(docs: DataFrame) -> DataFrame:
    """The table `documents`, or a stream of it, as articles."""
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    published = "timestampadd(HOUR, cast((doc_id * 37) % 720 as int), timestamp_ntz'2024-01-01 00:00:00')"
    return docs.select(
        F.col("doc_id").alias("id"),
        F.substring(head, 1, 120).alias("title"),  # for display; keys are of the whole line
        head.alias("headline"),
        F.concat(F.lit("https://docs.local/"), F.col("doc_id")).alias("url"),
        "source",
        F.col("text").alias("summary"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("10.1/"), F.col("doc_id") % 97)).alias("doi"),
        T.content_hash(head).alias("content_hash"),
        F.expr(published).alias("published_at"),
        F.expr("timestampadd(MINUTE, cast(doc_id % 1000 as int), timestamp_ntz'2024-01-31 00:00:00')").alias("fetched_at"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions_of(table(spark, sf_dir, "events"))


def interactions_of(events: DataFrame) -> DataFrame:
    """The table `events`, or a stream of it, as interactions."""
    kind = F.expr("case event_type when 'view' then 'read' when 'purchase' then 'bookmark' when 'click' then 'like' when 'error' then 'hide' else 'search' end")
    return events.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("article_id"),
        kind.alias("interaction_type"),
        F.when(kind == "read", F.floor("value").cast("int")).alias("read_time_seconds"),
        F.col("ts").alias("created_at"),
    )
