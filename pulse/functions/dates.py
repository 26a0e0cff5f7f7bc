"""Date and time expressions. Results do not depend on the session zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display order of weekday names.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

_HAS_ZONE = r"(?i)(z|utc|gmt|[+-]\d{2}(:?\d{2})?)\s*$"
_DATE_ONLY = r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"


def to_local(column: str | Column, zone: str = "Asia/Singapore") -> Column:
    """Parse text as UTC unless it names its own zone, and give wall-clock time in ``zone``."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    zoned = F.when(F.regexp_like(text, F.lit(_DATE_ONLY)), F.concat(text, F.lit(" 00:00:00Z")))
    zoned = zoned.when(F.regexp_like(text, F.lit(_HAS_ZONE)), text).otherwise(F.concat(text, F.lit("Z")))
    # Through the session zone and back out of it, so the setting cancels out.
    return F.convert_timezone(F.current_timezone(), F.lit(zone), zoned.cast("timestamp").cast("timestamp_ntz"))


def date_part(column: str | Column) -> Column:
    return F.to_date(column)


def time_part(column: str | Column) -> Column:
    return F.date_format(column, "HH:mm:ss")


def day_of_week(column: str | Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(column) + 1


def weekday_name(column: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(column) + 1)


def week_of_year(column: str | Column) -> Column:
    """Week number from 0, weeks starting on Monday (``%W``)."""
    return F.floor((F.dayofyear(column) + 6 - F.weekday(column)) / 7)


def month_day(column: str | Column) -> Column:
    """``MM-dd``: the axis of the time charts, with years folded together."""
    return F.date_format(column, "MM-dd")


def period_start(column: str | Column, unit: str) -> Column:
    """First day of the week, month or year; ``day`` leaves the date as it is."""
    return F.to_date(column) if unit == "day" else F.trunc(column, unit)


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    """Hours from ``earlier`` to ``later`` with microsecond precision."""
    micros = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def bounds(
    dates: tuple[dt.date, dt.date], start: dt.time = dt.time(0, 0), end: dt.time = dt.time(23, 59)
) -> tuple[dt.datetime, dt.datetime]:
    """First and last instant of a date range; the default end leaves out the last minute."""
    return dt.datetime.combine(dates[0], start), dt.datetime.combine(dates[1], end)


def last_day(latest: dt.datetime) -> tuple[dt.date, dt.date]:
    """Default range: the day before the newest article up to its day."""
    return (latest - dt.timedelta(days=1)).date(), latest.date()
