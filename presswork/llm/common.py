"""What the training-data operators share: tables, scratch tables, part counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_folder, small  # noqa: F401
from ..shipping import ship

#: A word of a text, as the contracts define it (everything but ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside the operators, so that keys are never null.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Number of hash parts for work whose size follows the input: it grows with
    the input's size and is never below four for each shuffle partition. (Plans over
    joins can claim any size; a million parts are taken as the most that is meant.)"""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(4 * shuffle_partitions(df.sparkSession), min(size // bytes_each, 1 << 20))


class Scratch:
    """Tables written to the shared folder; reading one again cuts the lineage, and
    a lost executor costs no more than the tasks it was running. Results are read from
    them, so they stay until clear_scratch()."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        vars(spark.sparkContext).setdefault("_presswork_scratch", []).append(self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def drop(self, saved: DataFrame) -> None:
        delete(self.spark, saved._scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the tables that this session's operators have written on the way. To be
    called when no result that reads them is needed any more."""
    for path in vars(spark.sparkContext).pop("_presswork_scratch", []):
        delete(spark, path)


def _keys() -> list:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(text, F.sha2(text, 256)), text]


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc, tid, text): doc_id without nulls, a 64-bit name of the text, and the text
    itself (null as empty). Rows are told apart by (doc, tid)."""
    ship(docs.sparkSession)
    return docs.select(*[c.alias(n) for c, n in zip(_keys(), ("doc", "tid", "text"))])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def with_keys(docs: DataFrame, names: tuple[str, str] = ("__doc", "__tid")) -> DataFrame:
    """docs with the keys of keyed_texts() under these names."""
    doc, tid, _ = _keys()
    return docs.withColumns(dict(zip(names, (doc, tid))))


def doc_id_of(column: str = "doc"):
    return F.when(F.col(column) != NO_ID, F.col(column))
