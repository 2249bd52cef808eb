"""Time buckets: 5 minutes, hours, days, Monday weeks, months and longer."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds per fixed-length unit.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
CALENDAR_UNITS = ("month", "quarter", "year")
# Multi-day and multi-week buckets are counted from this Monday.
WEEK_ORIGIN = "2000-01-03"


def parse_width(width: str) -> tuple[int, str]:
    match = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", width.lower())
    if not match or match[2] not in (*UNIT_SECONDS, *CALENDAR_UNITS):
        raise ValueError(f"unsupported bucket width: {width!r}")
    return int(match[1]), match[2]


def width_seconds(width: str) -> int:
    n, unit = parse_width(width)
    if unit in CALENDAR_UNITS:
        raise ValueError(f"{width!r} has no fixed length in seconds")
    return n * UNIT_SECONDS[unit]


def bucket_start(ts: Column | str, width: str = "1 day") -> Column:
    """Start of the bucket that holds ``ts``; NULL stays NULL."""
    n, unit = parse_width(width)
    ts = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")
    if n == 1:
        return F.date_trunc(unit, ts)
    if unit in CALENDAR_UNITS:
        raise ValueError(f"only single calendar units are supported, not {width!r}")
    if unit in ("day", "week"):
        days = n * (7 if unit == "week" else 1)
        origin = F.unix_date(F.lit(WEEK_ORIGIN).cast("date"))
        passed = F.floor((F.unix_date(ts.cast("date")) - origin) / F.lit(days))
        return F.date_from_unix_date((origin + passed * days).cast("int")).cast("timestamp")
    seconds = n * UNIT_SECONDS[unit]
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / F.lit(seconds)) * seconds)


def window_args(width: str) -> tuple[str, str, str]:
    """(window, slide, offset) for ``F.window`` so that streams share the batch buckets.

    Spark counts windows from 1970-01-01, a Thursday; weeks need four days more.
    """
    seconds = width_seconds(width)
    _, unit = parse_width(width)
    offset = "4 days" if unit == "week" else "0 seconds"
    return f"{seconds} seconds", f"{seconds} seconds", offset


def between(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Optional closed date filter: applied only when both bounds are given."""
    if start is None or end is None:
        return df
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def since(df: DataFrame, ts: str, days: int, as_of=None) -> DataFrame:
    """Rows from ``days`` before the day of ``as_of`` on.

    ``as_of`` defaults to the newest timestamp of the data, never the wall clock,
    so that a re-run over the same table gives the same rows. The bound is a literal, so that the filter moves below
    the aggregations that ``df`` is made of.
    """
    if as_of is None:
        as_of = df.agg(F.max(ts)).first()[0]
        if as_of is None:
            return df.filter(F.lit(False))
    limit = F.date_sub(F.lit(as_of).cast("timestamp").cast("date"), days).cast("timestamp")
    return df.filter(F.col(ts) >= limit)
