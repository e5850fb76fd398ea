"""Readers of feed, abstract and preprint files in the canonical article columns."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..shipping import ship

Source = Callable[[SparkSession], DataFrame]
#: The subject areas that a preprint server is asked for by default.
CATEGORIES = [
    "bioengineering",
    "cancer biology",
    "cell biology",
    "genomics",
    "immunology",
    "molecular biology",
    "neuroscience",
    "pharmacology and toxicology",
    "synthetic biology",
    "systems biology",
    "bioinformatics",
    "biophysics",
    "biochemistry",
    "evolutionary biology",
]


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, error) of every file under path that isn't well-formed XML."""
    ship(spark)

    def run(frames):
        for frame in frames:
            found = []
            for file, text in zip(frame["file"], frame["value"]):
                try:
                    ET.fromstring(text)
                except ET.ParseError as error:
                    found.append({"file": file, "error": str(error)})
            if found:
                yield pd.DataFrame(found)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInPandas(run, "file string, error string")


def rss(spark: SparkSession, path: str, name: str) -> DataFrame:
    """RSS items; those without link or title are left out. If there are no items at all,
    a file that isn't well-formed XML is an error."""
    ship(spark)
    schema = "title string, link string, description string, pubDate string, updated string"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    if items.isEmpty() and (broken := broken_files(spark, path).first()) is not None:
        raise ValueError(f"{broken.file}: {broken.error}")
    return items.filter("title is not null and link is not null").select(
        T.clean_feed_text("title").alias("title"), F.trim("link").alias("url"), F.lit(name).alias("source"), T.clean_feed_text("description").alias("summary"), D.parse_feed_date(F.col("pubDate"), F.col("updated")).alias("published_at")
    )


def _pubmed_rows(text: str) -> list[dict]:
    found = []
    said = lambda node: "".join(node.itertext()).strip() if node is not None else ""
    for record in ET.fromstring(text).iter("PubmedArticle"):
        pmid, title = said(record.find(".//PMID")), said(record.find(".//ArticleTitle"))
        if not pmid or not title:
            continue
        when = record.find(".//PubDate")
        part = lambda tag: when.findtext(tag) if when is not None else None  # noqa: B023, E731
        found.append(
            {
                "pmid": pmid,
                "title": title,
                "sections": [{"label": s.get("Label"), "text": said(s)} for s in record.iterfind(".//Abstract/AbstractText")],
                "names": [{"last": a.findtext("LastName"), "fore": a.findtext("ForeName"), "initials": a.findtext("Initials")} for a in record.iterfind(".//Author")],
                "doi": next((said(i) for i in record.iterfind(".//ArticleId") if i.get("IdType") == "doi"), None),
                "year": part("Year"),
                "month": part("Month"),
                "day": part("Day"),
            }
        )
    return found


def pubmed(spark: SparkSession, path: str, limit: int | None = None, strict: bool = True) -> DataFrame:
    """PubMed records; of a limited number the first by file and place in it. Titles and
    abstracts mix text and markup in an order that the XML reader loses, so whole files
    are parsed in Python. A file that doesn't parse is an error that names it; with
    strict=False such files are left out, and broken_files() lists them."""
    ship(spark)
    schema = "file string, place int, pmid string, title string, sections array<struct<label:string,text:string>>, names array<struct<last:string,fore:string,initials:string>>, doi string, year string, month string, day string"

    def run(frames):
        for frame in frames:
            rows = []
            for file, text in zip(frame["file"], frame["value"]):
                try:
                    rows += [{"file": file, "place": i, **row} for i, row in enumerate(_pubmed_rows(text))]
                except ET.ParseError as error:
                    if strict:
                        raise ValueError(f"{file}: {error}") from error
            if rows:
                yield pd.DataFrame(rows)

    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(run, schema)
    rows = rows if limit is None else rows.orderBy("file", "place").limit(limit)
    return rows.select(
        T.clean_abstract("title").alias("title"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")).alias("url"),
        F.lit("PubMed").alias("source"),
        T.clean_abstract(T.join_sections(F.col("sections"))).alias("summary"),
        T.join_authors(F.col("names")).alias("authors"),
        "doi",
        F.concat(F.lit("pmid:"), "pmid").alias("external_id"),
        D.parse_pub_date(F.col("year"), F.col("month"), F.col("day")).alias("published_at"),
    )


def preprints(spark: SparkSession, path: str, server: str = "biorxiv", categories: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Preprint pages ({"collection": [...]}) of a server; doi and title are needed. Of a
    limited number, the first by file and place in it."""
    ship(spark)
    record = "struct<doi:string,title:string,abstract:string,authors:string,date:string,category:string,server:string,version:string>"
    rows = spark.read.schema(f"collection array<{record}>").json(path, multiLine=True).select(F.col("_metadata.file_path").alias("_file"), F.posexplode("collection").alias("_place", "r")).select("_file", "_place", "r.*")
    rows = rows.filter("coalesce(doi, '') <> '' and coalesce(title, '') <> ''")
    rows = rows if categories is None else rows.filter(F.lower("category").isin([c.lower() for c in categories]))
    rows = rows if limit is None else rows.orderBy("_file", "_place").limit(limit)
    version = F.coalesce(F.col("version").try_cast("int"), F.lit(1))
    authors = F.array_join(F.filter(F.transform(F.split("authors", ";"), lambda a: F.trim(a)), lambda a: a != ""), "; ")
    suffix = F.when(version > 1, F.concat(F.lit("v"), version.cast("string"))).otherwise("")
    return rows.select(
        T.clean_abstract("title").alias("title"),
        F.concat(F.lit(f"https://www.{server}.org/content/"), "doi", suffix).alias("url"),
        F.concat(F.initcap(F.lit(server)), F.lit(" ("), F.coalesce("category", F.lit("unknown")), F.lit(")")).alias("source"),
        T.clean_abstract("abstract").alias("summary"),
        F.nullif(authors, F.lit("")).alias("authors"),
        "doi",
        F.concat(F.lit(f"{server}:"), "doi", suffix).alias("external_id"),
        D.parse_iso_date(F.col("date")).alias("published_at"),
    )


def trials(spark: SparkSession, path: str) -> DataFrame:
    """(nct_id, title) from trial registry records (JSON, one a file); records without a
    number or title are left out."""
    module = "struct<nctId:string,briefTitle:string>"
    rows = spark.read.schema(f"protocolSection struct<identificationModule:{module}>").json(path, multiLine=True).select("protocolSection.identificationModule.*")
    return rows.filter("coalesce(nctId, '') <> '' and coalesce(briefTitle, '') <> ''").select(F.col("nctId").alias("nct_id"), F.col("briefTitle").alias("title"))


def gazetteer(spark: SparkSession, path: str) -> list[dict]:
    """The entities of a dictionary file ({"entities": [{name, type, external_source,
    external_id, aliases}]}), in its order; dictionaries are read into the driver."""
    entity = "struct<name:string,type:string,external_source:string,external_id:string,aliases:array<string>>"
    rows = spark.read.schema(f"entities array<{entity}>").json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode("entities").alias("place", "e"))
    return [r.e.asDict() for r in rows.orderBy("file", "place").collect()]


def labelled_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles: id, title, summary, source; queries: query, text, relevant ids) of a file of
    labelled searches ({"corpus": [...], "queries": [{query, relevant_ids}]})."""
    schema = "corpus array<struct<id:bigint,title:string,summary:string,source:string>>, queries array<struct<query:string,relevant_ids:array<bigint>>>"
    data = spark.read.schema(schema).json(path, multiLine=True)
    queries = data.select(F.posexplode("queries").alias("n", "q"))
    return data.select(F.explode("corpus").alias("c")).select("c.*"), queries.select(F.col("n").cast("bigint").alias("query"), F.col("q.query").alias("text"), F.col("q.relevant_ids").alias("relevant"))


def date_range(as_of: date, days: int = 7) -> tuple[str, str]:
    """The rolling range [as_of - days, as_of] that a preprint server is asked for."""
    return (as_of - timedelta(days=days)).isoformat(), as_of.isoformat()


def registry(root: str, feeds: dict[str, str]) -> dict[str, Source]:
    """Named sources under a folder: RSS files by feed name, pubmed/, biorxiv/, medrxiv/."""
    found: dict[str, Source] = {name: (lambda spark, n=name, f=file: rss(spark, f"{root}/{f}", n)) for name, file in feeds.items()}
    found["PubMed"] = lambda spark: pubmed(spark, f"{root}/pubmed")
    for server in ("biorxiv", "medrxiv"):
        found[server] = lambda spark, s=server: preprints(spark, f"{root}/{s}", s, CATEGORIES)
    return found
