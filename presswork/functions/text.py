"""Text functions: Column -> Column."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalize_title(title: Column) -> Column:
    """Lower case; everything but a-z, 0-9 and space is a space; single spaces."""
    plain = F.regexp_replace(F.lower(title), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def content_hash(title: Column) -> Column:
    """SHA-256 of the normalised title. Titles without ASCII letters or digits collide."""
    return F.sha2(normalize_title(title), 256)


def embedding_text(title: Column, summary: Column, limit: int = 2000) -> Column:
    """Title and, unless empty, summary after a full stop; the first `limit` characters."""
    return F.substring(F.concat_ws(". ", title, F.nullif(summary, F.lit(""))), 1, limit)


def entity_text(title: Column, summary: Column) -> Column:
    return F.concat(title, F.lit(" "), F.coalesce(summary, F.lit("")))


def nct_ids(text: Column) -> Column:
    """Trial numbers in the order of first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bNCT[0-9]{8}\b"), F.lit(0)))


def strip_tags(text: Column) -> Column:
    """Tags out, white space collapsed, null if nothing is left; entities stay."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\s+", " "))
    return F.nullif(plain, F.lit(""))


_space = re.compile(r"\s+")


class _Nodes(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


def _collapsed(text: str) -> str | None:
    return _space.sub(" ", text).strip() or None


def feed_markup_to_text(text: str | None) -> str | None:
    """Text nodes of an HTML fragment; entities are then resolved once more."""
    if text is None:
        return None
    parser = _Nodes()
    parser.feed(text)
    parser.close()
    return _collapsed(html.unescape("".join(parser.found)))


def abstract_markup_to_text(text: str | None) -> str | None:
    """Tags are cut out first, so that escaped tags stay as text."""
    return _collapsed(html.unescape(re.sub(r"<[^>]+>", "", text))) if text else None


@F.pandas_udf(StringType())
def clean_feed_text(values: pd.Series) -> pd.Series:
    return values.map(feed_markup_to_text, na_action="ignore").astype(object)


@F.pandas_udf(StringType())
def clean_abstract(values: pd.Series) -> pd.Series:
    return values.map(abstract_markup_to_text, na_action="ignore").astype(object)


def join_authors(names: Column) -> Column:
    """array<struct<last, fore, initials>> as "Fore Last; ..."."""
    one = lambda a: F.trim(F.concat_ws(" ", F.coalesce(a["fore"], a["initials"]), a["last"]))
    return F.nullif(F.array_join(F.transform(F.filter(names, lambda a: a["last"].isNotNull()), one), "; "), F.lit(""))


def join_sections(sections: Column) -> Column:
    """array<struct<label, text>> as "Label: text ..."."""
    one = lambda s: F.when(F.coalesce(s["label"], F.lit("")) != "", F.concat(s["label"], F.lit(": "), s["text"])).otherwise(s["text"])
    return F.array_join(F.transform(sections, one), " ")
