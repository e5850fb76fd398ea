"""Scalar scores of articles and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Source names and their quality.
TOP_JOURNALS = ["Nature", "Science", "Cell", "NEJM", "Lancet", "Nature Medicine"]
HIGH_IMPACT_JOURNALS = [
    "Nature Biotechnology",
    "Nature Methods",
    "Nature Genetics",
    "Cell Reports",
    "Molecular Cell",
    "Immunity",
    "Cancer Cell",
    "Science Translational Medicine",
    "Science Immunology",
]
MAJOR_NEWS = ["STAT News", "FiercePharma", "BioPharma Dive", "GEN", "Endpoints News"]


def source_quality(source: Column, any_case: bool = True) -> Column:
    """1.0 to 0.3 by source. Preprint servers are found in any case, as sources write
    their names; any_case=False looks for the exact names only."""
    preprint = F.lower(source).rlike("biorxiv|medrxiv") if any_case else source.rlike("bioRxiv|medRxiv")
    return (
        F.when(source.isin(TOP_JOURNALS), 1.0)
        .when(source.isin(HIGH_IMPACT_JOURNALS), 0.9)
        .when(source.isin(MAJOR_NEWS), 0.7)
        .when(preprint, 0.6)
        .when(source == "PubMed", 0.5)
        .otherwise(0.3)
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
