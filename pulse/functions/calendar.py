"""Time as whole seconds since 1970, so that no result depends on a session's time zone."""

from __future__ import annotations

from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400


def seconds(ts):
    """Seconds of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts).cast("long")


def start_of(sec, unit: int):
    return (F.floor(sec / unit) * unit).cast("long")


def hour_of_day(sec):
    return (F.floor(sec / HOUR) % 24).cast("long")


def day_of_week(sec):
    """0 is Monday."""
    return ((F.floor(sec / DAY) + 3) % 7).cast("long")


def is_weekend(sec):
    return day_of_week(sec) >= 5


def date_of(sec):
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(sec / DAY).cast("int"))


def month_of(sec):
    """yyyy-MM"""
    return F.date_format(date_of(sec), "yyyy-MM")


def hours_between(start, end):
    return (end - start) / F.lit(3600.0)
