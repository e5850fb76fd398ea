"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, as in tests, a temporary
    folder serves on one machine; on a cluster other executors couldn't see it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return (folder or context.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """The name of a folder in the shared one, for a table or an index. clear() deletes it."""
    path = f"{shared_folder(spark)}/presswork-{uuid.uuid4().hex}"
    vars(spark.sparkContext).setdefault("_presswork_folders", []).append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder once: its lineage ends there, and it can be read
    several times. The table stays until clear()."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what this session's operators have stored on the way. To be called when no
    result that reads it is needed any more."""
    for path in vars(spark.sparkContext).pop("_presswork_folders", []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Tables of at most so many bytes, as measured from their rows, are broadcast.
MOST_BROADCAST = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows are counted and measured to be few bytes; else
    the join is by shuffle. df must be cheap to read."""
    wide = [F.coalesce(F.size(c) if t.startswith("array") else F.length(c), F.lit(0)) for c, t in df.dtypes if t.startswith(("array", "string", "binary"))]
    size = F.sum(sum(wide, F.lit(len(df.columns))).cast("long") * 8)
    return F.broadcast(df) if (df.agg(size).first()[0] or 0) <= MOST_BROADCAST else df
