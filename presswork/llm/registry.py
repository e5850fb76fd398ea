"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, oracle
from .common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe -7 as chains of replies, formatted and read back."""
    rows = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_trees(chat.chains(rows), unique=True))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    from .decontaminate import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc", "tid")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and entropy spans of every document."""
    from .secret_scan import report

    return report(table(spark, sf_dir, "documents"))


def op4_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 50-word windows of smaller documents, removed."""
    from .fm_index import remove_repeated_windows

    return remove_repeated_windows(table(spark, sf_dir, "documents"), window=50, with_text=False).drop("kept")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 100-byte strings that start earlier, removed."""
    from .suffix_sort import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), window=100, with_text=False).drop("kept")


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes they decode to."""
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word sets, similarity 0.8."""
    from .ngram_join import near_copies

    return near_copies(table(spark, sf_dir, "documents")).drop("doc", "tid")


def op8_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of the quality rules for every document."""
    from .line_rules import report

    return report(table(spark, sf_dir, "documents"))


def op9_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts, read from the rewritten files."""
    from .resharding import by_rows

    return by_rows(table(spark, sf_dir, "documents"), shards=16)


def op10_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the training fold."""
    from .pu_toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document by longest matches and steps back, and their text."""
    from .piece_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and by which terms."""
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds of 40 centroids."""
    from .centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_secret_scans": op3_secret_scans,
    "op4_fm_index_dedup": op4_fm_index_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_byte_level_bpe": op6_byte_level_bpe,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_line_quality_rules": op8_line_quality_rules,
    "op9_min_cost_resharding": op9_min_cost_resharding,
    "op10_pu_toxicity": op10_pu_toxicity,
    "op11_piece_encoding": op11_piece_encoding,
    "op12_source_divergence": op12_source_divergence,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE: dict[str, str] = dict(oracle.SQL)
