"""Time and rounding helpers shared by reports and alerts."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(ts) -> Column:
    """A TIMESTAMP_NTZ literal (wall-clock time, no zone)."""
    if isinstance(ts, str):
        ts = _dt.datetime.fromisoformat(ts)
    # A string cast is zone-free, unlike a Python datetime literal.
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def hours_before(as_of, hours: float) -> Column:
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    return ts_lit(as_of - _dt.timedelta(hours=hours))


def minutes_before(as_of, minutes: float) -> Column:
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    return ts_lit(as_of - _dt.timedelta(minutes=minutes))


def hour_text(c: Column) -> Column:
    """`yyyy-MM-dd HH:00:00`, the bucket label of the hourly reports."""
    return F.date_format(c, "yyyy-MM-dd HH:00:00")


def day_range(as_of):
    """Half-open [start of day, next day) of ``as_of``: a sargable form of DATE(x)=CURDATE()."""
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    start = _dt.datetime(as_of.year, as_of.month, as_of.day)
    return ts_lit(start), ts_lit(start + _dt.timedelta(days=1))


def round_half_up(c: Column, scale: int) -> Column:
    """Java ``Math.round(x * 10^s) / 10^s`` (half-up on the scaled value)."""
    f = float(10 ** scale)
    return F.floor(c * f + 0.5) / f


def percent_1dp(ratio: Column) -> Column:
    """``Math.round(r * 1000) / 10.0``: a ratio as a percentage with one decimal."""
    return F.floor(ratio * 1000.0 + 0.5) / 10.0
