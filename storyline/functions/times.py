"""Timestamp expressions; all in the session zone, which is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyline import constants as C


def parse_published(text: Column) -> Column:
    """Timestamp of the text: general parse, then the fixed feed format, else null.

    A text without a leading year is no timestamp: words such as ``now`` and bare
    times would otherwise take the clock of the run.
    """
    parsed = F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")),
    )
    return F.when(text.rlike(r"^\s*[0-9]{4}"), parsed)


def lower_date_bound(as_of: Column, days: int = C.FEED_WINDOW_DAYS) -> Column:
    return F.date_format(F.date_sub(F.to_date(as_of), days), "yyyy-MM-dd")


def batch_stamp(as_of: Column) -> Column:
    return F.unix_seconds(as_of)


def is_new(published: Column, as_of: Column) -> Column:
    """Strictly younger than a day."""
    age = F.unix_micros(as_of) - F.unix_micros(published)
    return age < C.NEW_WITHIN_SECONDS * 1_000_000


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def zone_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss Z")
