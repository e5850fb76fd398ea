"""A training corpus from `documents`: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
All but the last return the columns of documents, whatever else docs has, unchanged. Null
and empty texts, null ids and rows without a source pass all stages; texts are taken whole
however long; an empty table comes out empty. docs needs doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import bpe, decontaminate, ngram_join, pu_toxicity, secret_scan
from presswork.llm.common import Scratch, fresh, small, table, with_keys


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It is trained on docs and the table
    `labels`; without toxic labels none goes. Repeated rows fare alike; a null text scores
    as an empty one."""
    model = pu_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, toxic = fresh(docs, "score", "toxic")
    return pu_toxicity.score(docs, model, (score, toxic)).filter(F.col(toxic) == 0).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, once;
    documents without words are groups of their own. A null doc_id counts as the
    smallest. Of rows equal in doc_id and text, the one with the smallest hash of all
    columns stays."""
    groups = ngram_join.near_copies(docs)
    doc, tid, row = fresh(docs, "doc", "tid", "row")
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc").alias(doc), F.col("tid").alias(tid)).distinct()
    keyed = with_keys(docs, (doc, tid)).select(doc, tid, F.struct(*_columns(docs)).alias(row))
    kept = keyed.join(first.hint("shuffle_hash"), [doc, tid], "left_semi")
    one = kept.groupBy(doc, tid).agg(F.min_by(row, F.xxhash64(row)).alias(row))
    return one.select(*[F.col(f"{row}.`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the table `benchmark` go. Repeated rows fare
    alike; documents without words stay."""
    found = decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"))
    doc, tid = fresh(docs, "doc", "tid")
    found = Scratch(spark).save(found.select(F.col("doc").alias(doc), F.col("tid").alias(tid)).distinct())
    return with_keys(docs, (doc, tid)).join(small(found), [doc, tid], "left_anti").select(*_columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars, if there, follows. Each row is scanned by
    itself; null and clean texts stay as they are."""
    scanned = secret_scan.scan(docs.select(F.col("text"), F.struct(*_columns(docs)).alias("row")))
    masked = secret_scan.mask(scanned)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")
    return masked.select(*[new.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source (where docs has them) with ids, the text's token ids
    (little-endian unsigned 32-bit), n_tokens and ids_sha256, for every row. Null and
    empty texts have no tokens."""
    ids = bpe.encode(docs.select(*[c for c in ("doc_id", "lang", "source", "text") if c in docs.columns])).drop("text")
    return ids.withColumn("n_tokens", F.expr("cast(octet_length(ids) div 4 as bigint)")).withColumn("ids_sha256", F.sha2("ids", 256))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("byte_level_bpe", tokens),
]

#: Training a classifier and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table `documents`; every one but the last is written to the
    shared folder as Parquet and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
