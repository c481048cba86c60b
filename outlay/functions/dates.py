"""Day arithmetic.  ``as_of`` is always an explicit ``datetime.date`` or ``datetime``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_lit(day: dt.date) -> Column:
    return F.lit(day).cast("date")


def ts_lit(moment: dt.datetime) -> Column:
    """A wall-clock (UTC) literal without a time zone."""
    return F.to_timestamp_ntz(F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")))


def months_back(day: dt.date, months: int) -> dt.date:
    """First day of the month ``months`` months before ``day``."""
    index = day.year * 12 + day.month - 1 - months
    return dt.date(index // 12, index % 12 + 1, 1)


def age_days(ts: Column, now: Column) -> Column:
    """Whole 24-hour periods between ``ts`` and ``now``, never negative."""
    return F.greatest(F.lit(0), F.timestamp_diff("DAY", ts, now)).cast("int")


def calendar_days(earlier: Column, later: Column) -> Column:
    return F.date_diff(F.to_date(later), F.to_date(earlier))


def local_time(ts: Column, tz: str) -> Column:
    """Wall-clock time in ``tz`` of a UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def utc_time(text: Column) -> Column:
    """UTC wall-clock time of a timestamp text with Z or an offset; NULL when it is malformed."""
    moment = F.try_to_timestamp(text).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment)
