"""Time helpers. All times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_iso(text: Column) -> Column:
    """Timestamp of an ISO-8601 text, null where it cannot be read."""
    return F.try_to_timestamp(text)


def to_iso_ms(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def to_ms(at: Column) -> Column:
    return F.unix_millis(at.cast("timestamp"))


def plus_days(at: Column, days: int) -> Column:
    return at + F.make_dt_interval(F.lit(days))


def age_seconds(since: Column, at: Column) -> Column:
    return (F.unix_micros(at.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1_000_000
