"""Ingestion: sources to stored articles, with a record of each run."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INGESTION_RUNS
from .dedup import three_tier


def read_sources(sources: dict[str, Callable[[SparkSession], DataFrame]], spark: SparkSession) -> tuple[DataFrame | None, dict[str, str]]:
    """All sources' rows together (by column name, missing ones null), and the errors of
    those that failed; a failing source doesn't stop the others."""
    frames, errors = [], {}
    for name, read in sources.items():
        try:
            df = read(spark)
            df.limit(1).count()  # sources fail when they are first read
            frames.append(df)
        except Exception as error:  # noqa: BLE001
            errors[name] = message(error)
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None), errors


def message(error: Exception) -> str:
    """What an error says, in a line. Of one raised in a worker that is the last line of its
    Python traceback; the JVM's stack after it says nothing."""
    lines = [line.strip() for line in str(error).splitlines()]
    python = [i for i, line in enumerate(lines) if line.startswith("Traceback (most recent call last)")]
    said = []
    for line in lines[python[-1] + 1 :] if python else lines:
        if python and said and (not line or line.startswith(("at ", "Driver stacktrace", "JVM stacktrace", "org.apache"))):
            break
        if line:
            said.append(line)
            if not python:
                break
    return said[-1] if said else type(error).__name__


def created(incoming: DataFrame, stored: DataFrame | None = None, order: str = "id") -> DataFrame:
    """incoming with `created`: whether the row is stored (SNK: insert if absent)."""
    kept = three_tier(incoming, order=order, history=stored).select(order).withColumn("_kept", F.lit(True))
    return incoming.join(kept, order, "left").withColumn("created", F.coalesce("_kept", F.lit(False))).drop("_kept")


def counts(marked: DataFrame) -> DataFrame:
    """(source, added, duplicates)."""
    return marked.groupBy("source").agg(F.sum(F.col("created").cast("bigint")).alias("added"), F.sum((~F.col("created")).cast("bigint")).alias("duplicates"))


def run_record(spark: SparkSession, per_source: DataFrame, errors: dict[str, str], started_at: datetime, finished_at: datetime, embedded: int = 0, entities: int = 0, run_id: int = 1) -> DataFrame:
    """One row of ingestion_runs."""
    added = per_source.agg(F.map_from_entries(F.collect_list(F.struct("source", F.col("added").cast("int").alias("n")))).alias("added"))
    failed = F.create_map(*[F.lit(x) for pair in errors.items() for x in pair]) if errors else F.create_map().cast("map<string,string>")
    row = added.select(
        F.lit(run_id).cast("bigint").alias("id"),
        F.lit(started_at).cast("timestamp_ntz").alias("started_at"),
        F.lit(finished_at).cast("timestamp_ntz").alias("finished_at"),
        F.aggregate(F.map_values("added"), F.lit(0), lambda s, x: s + x).alias("added_total"),
        F.lit(len(errors)).alias("error_count"),
        F.struct(F.col("added").alias("added"), failed.alias("errors"), F.lit(embedded).alias("embedded"), F.lit(entities).alias("entities_extracted")).alias("detail"),
    )
    return row.to(spark.createDataFrame([], INGESTION_RUNS).schema)


def surviving(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children whose parent still exists (delete cascades)."""
    return children.join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
