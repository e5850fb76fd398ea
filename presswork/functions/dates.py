"""Dates of sources, and freshness against an explicit point in time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = {name: i for i, name in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}


def parse_pub_date(year: Column, month: Column, day: Column) -> Column:
    """Year needed; months by their English names (numbers count as January); first day
    by default; null for impossible dates."""
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    m = F.coalesce(F.try_element_at(names, F.substring(month, 1, 3)), F.lit(1))
    d = F.when(day.isNull(), F.lit(1)).otherwise(day.try_cast("int"))
    return F.try_make_timestamp_ntz(year.try_cast("int"), m, d, F.lit(0), F.lit(0), F.lit(0))


def parse_iso_date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")


def parse_feed_date(published: Column, updated: Column | None = None) -> Column:
    """RFC 822 dates, read as UTC; the update stands in for the publication."""
    one = lambda c: F.try_to_timestamp(F.trim(F.regexp_replace(F.regexp_replace(c, "^[A-Za-z]{3}, *", ""), "(?i)(?:GMT|UTC?|Z)$", "+0000")), F.lit("d MMM yyyy HH:mm:ss Z"))
    found = one(published) if updated is None else F.coalesce(one(published), one(updated))
    return found.cast("timestamp_ntz")


def freshness_days(published: Column, as_of: datetime, cap: int = 365) -> Column:
    """Whole days since publication, at most `cap`; `cap` if unknown. Future dates are negative."""
    seconds = F.unix_micros(F.lit(as_of).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(published.cast("timestamp"))
    return F.coalesce(F.least(F.floor(seconds / F.lit(86_400_000_000)), F.lit(cap)), F.lit(cap)).cast("double")
