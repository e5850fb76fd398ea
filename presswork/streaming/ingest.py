"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import three_tier
from ..operators.key_store import KeyStore


def ingest_stream(stream: DataFrame, store: str, checkpoint: str, after: dict[str, Callable[[DataFrame, int], None]] | None = None, on_error: Callable[[str, int, Exception], None] | None = None, every: str | None = None):
    """Starts a query that deduplicates each batch against all that is stored, appends
    the new rows under their batch number and runs the stages in `after` (embedding,
    extraction, records), each by itself. A batch that runs again after a failure
    replaces its own files, so rows are stored once. The keys of stored rows are in
    store/_keys, and a batch reads those buckets only that it may hit. every: e.g. "60
    minutes"; None takes all that is there and stops."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = KeyStore(spark, f"{store}/_keys")
        new = three_tier(batch, history=keys.history(batch, but=number))
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")
        new = spark.read.schema(batch.schema).parquet(f"{store}/batch={number}")
        keys.add(new, number)
        for name, stage in (after or {}).items():
            try:
                stage(new, number)
            except Exception as error:  # noqa: BLE001  one stage's failure is not another's
                if on_error is None:
                    raise
                on_error(name, number, error)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def counts_by_source(stream: DataFrame, time: str = "published_at", window: str = "1 day", late: str = "48 hours") -> DataFrame:
    """(window, source, n): tumbling counts with a watermark."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", window).alias("w"), "source").agg(F.count(F.lit(1)).alias("n"))
