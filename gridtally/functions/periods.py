"""Period keys of readings and period filters of reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def hour_of(timestamp: Column) -> Column:
    return F.date_trunc("hour", timestamp)


def week_of(day: Column) -> Column:
    """The Monday of the week, as a date."""
    return F.trunc(day, "week")


def month_of(day: Column) -> Column:
    """The first day of the month, as a date."""
    return F.trunc(day, "month")


def day_in(day: Column, start: dt.date | None, end: dt.date | None) -> Column:
    """``day`` between ``start`` and ``end``, both included; None leaves a side open."""
    return _within(day >= F.lit(start), start) & _within(day <= F.lit(end), end)


def time_in(timestamp: Column, start: dt.date | None, end: dt.date | None) -> Column:
    """The day of ``timestamp`` between ``start`` and ``end``, both included.

    Written as a half-open range on the timestamp itself, which reaches the scan.
    """
    after_end = None if end is None else end + dt.timedelta(days=1)
    from_start = timestamp >= F.lit(start).cast("timestamp")
    before_end = timestamp < F.lit(after_end).cast("timestamp")
    return _within(from_start, start) & _within(before_end, end)


def _within(condition: Column, bound: dt.date | None) -> Column:
    return F.lit(True) if bound is None else condition
