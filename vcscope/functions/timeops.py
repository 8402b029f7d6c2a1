"""Date and time expressions (all UTC unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def days_between(later, earlier) -> Column:
    """Fractional days ``later - earlier`` (JULIANDAY difference)."""
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(MICROS_PER_DAY)


def iso(c) -> Column:
    """Timestamp as ISO-8601 UTC text, e.g. 2024-01-03T08:00:00Z."""
    return F.date_format(col(c), ISO_UTC)


def day(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def month(c) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def week(c) -> Column:
    """Monday of the ISO week, as yyyy-MM-dd."""
    return F.date_format(F.date_trunc("week", col(c)), "yyyy-MM-dd")


def period(c, unit: str) -> Column:
    if unit == "day":
        return day(c)
    if unit == "week":
        return week(c)
    if unit == "month":
        return month(c)
    raise ValueError(f"unknown unit {unit!r}")


def weekday(c) -> Column:
    """0 = Sunday … 6 = Saturday."""
    return F.dayofweek(col(c)) - F.lit(1)


def tz_offset_minutes(tz) -> Column:
    """Offset in minutes of a 'Z' / '+hh:mm' / '-hh:mm' text column."""
    tz = col(tz)
    sign = F.when(F.substring(tz, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    hh = F.substring(tz, 2, 2).try_cast("int")
    mm = F.substring(tz, 5, 2).try_cast("int")
    return F.when(tz.isNull() | (tz == "Z"), F.lit(0)).otherwise(sign * (hh * 60 + mm))


def local_time(date, tz) -> Column:
    """Wall-clock time at the commit's own offset."""
    return F.timestamp_seconds(F.unix_seconds(col(date)) + tz_offset_minutes(tz) * 60)


def start_of_day(d: str) -> Column:
    """``yyyy-MM-dd`` → that day 00:00:00 UTC (inclusive lower bound)."""
    return F.to_timestamp(F.lit(d + " 00:00:00"))


def end_of_day(d: str) -> Column:
    """``yyyy-MM-dd`` → that day 23:59:59 UTC (inclusive upper bound)."""
    return F.to_timestamp(F.lit(d + " 23:59:59"))
