"""Time-zone explicit calendar expressions over whole epoch seconds.

All of them work on zone-less timestamps, so no result depends on the session time zone.
"""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc_time(ts_sec) -> Column:
    """Epoch seconds as a zone-less UTC timestamp."""
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), _col(ts_sec))


def local_time(ts_sec, tz: str = "UTC") -> Column:
    """Epoch seconds as the wall-clock time of ``tz``."""
    if tz == "UTC":
        return utc_time(ts_sec)
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_time(ts_sec))


def utc_day(ts_sec) -> Column:
    return F.date_format(utc_time(ts_sec), "yyyy-MM-dd")


def utc_month(ts_sec) -> Column:
    return F.date_format(utc_time(ts_sec), "yyyy-MM")


def local_hour(ts_sec, tz: str = "UTC") -> Column:
    return F.hour(local_time(ts_sec, tz))


def local_weekday(ts_sec, tz: str = "UTC") -> Column:
    """Monday is 0."""
    return F.weekday(local_time(ts_sec, tz))


def period_keys(ts_sec, tz: str = "UTC") -> Column:
    """The three periods that a moment belongs to: everything, its year, its month."""
    local = local_time(ts_sec, tz)
    return F.array(F.lit("all"), F.date_format(local, "'y'yyyy"), F.date_format(local, "'y'yyyy'm'MM"))


def period_bounds(period_key: str, tz: str = "UTC") -> tuple[int, int] | None:
    """Epoch seconds [start, end) of ``all`` / ``y2024`` / ``y2024m03`` in local time."""
    if period_key == "all":
        return None
    year, _, month = period_key[1:].partition("m")
    zone = ZoneInfo(tz)
    y, m = int(year), int(month or 1)
    following = (y + 1, 1) if not month or m == 12 else (y, m + 1)
    start, end = (datetime(a, b, 1, tzinfo=zone) for a, b in ((y, m), following))
    return int(start.timestamp()), int(end.timestamp())


def period_bound_columns(period_key, tz: str = "UTC") -> tuple[Column, Column]:
    """The same bounds for a column of period keys (NULL for ``all``)."""
    key = _col(period_key)
    year = F.nullif(F.regexp_extract(key, r"^y(\d{4})", 1), F.lit("")).cast("int")
    month = F.nullif(F.regexp_extract(key, r"m(\d{2})$", 1), F.lit("")).cast("int")
    first = F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1))
    after = F.add_months(first, F.when(month.isNull(), F.lit(12)).otherwise(F.lit(1)))

    def epoch(day: Column) -> Column:
        wall = day.cast("timestamp_ntz")
        utc = wall if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), wall)
        return epoch_seconds(utc)

    return epoch(first), epoch(after)


def epoch_seconds(ntz) -> Column:
    """Whole seconds since 1970 of a zone-less UTC timestamp."""
    t = _col(ntz)
    days = F.date_diff(t.cast("date"), F.expr("DATE '1970-01-01'"))
    return (days.cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
            + F.floor(F.second(t))).cast("bigint")
