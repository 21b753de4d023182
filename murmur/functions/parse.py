"""Parsers of scraped fields as Catalyst expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timefmt import ts_lit

# The markers of the scraped relative-time and count formats.
MINUTES_AGO = "分钟前"
HOURS_AGO = "小时前"
TODAY = "今天"
TEN_THOUSAND = "万"


def parse_time(s: Column, as_of, compat: bool = False) -> Column:
    """Scraped time text -> TIMESTAMP_NTZ relative to ``as_of``.

    ``N分钟前`` / ``N小时前`` (all digits of the text), ``今天 HH:mm`` (no time ->
    12:00), ``MM-dd HH:mm`` in the year of ``as_of``, ``yyyy-MM-dd HH:mm``;
    anything else -> ``as_of``.  By default ``06月15日 12:30`` and
    ``今天12:30`` parse; ``compat=True`` keeps the original failures (as_of,
    resp. 12:00).
    """
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    now = ts_lit(as_of)
    day = F.lit(as_of.strftime("%Y-%m-%d"))
    year = F.lit(str(as_of.year))
    digits = F.regexp_replace(s, r"\D+", "")
    n = F.when(digits != "", digits.try_cast("long"))
    t = F.trim(s)
    if compat:
        cleaned = F.trim(F.regexp_replace(t, "[月日]", "-"))
        today_hm = F.regexp_extract(t, r"^今天\s+(\d{1,2}:\d{2})", 1)
    else:
        cleaned = F.trim(F.regexp_replace(F.regexp_replace(t, "月", "-"), "日", " "))
        cleaned = F.regexp_replace(cleaned, r"\s+", " ")
        today_hm = F.regexp_extract(t, r"^今天\s*(\d{1,2}:\d{2})", 1)
    md = F.regexp_extract(cleaned, r"^(\d{2}-\d{2}\s+\d{2}:\d{2})$", 1)
    today_time = F.when(today_hm != "", F.try_to_timestamp(F.concat(day, F.lit(" "), today_hm),
                                                           F.lit("yyyy-MM-dd H:mm")))
    full = F.try_to_timestamp(cleaned, F.lit("yyyy-MM-dd HH:mm"))
    with_year = F.try_to_timestamp(F.concat(year, F.lit("-"), md), F.lit("yyyy-MM-dd HH:mm"))
    minutes = F.timestamp_add("MINUTE", -n, now)
    hours = F.timestamp_add("HOUR", -n, now)
    noon = ts_lit(_dt.datetime(as_of.year, as_of.month, as_of.day, 12))
    parsed = (F.when(s.isNull(), now)
               .when(s.contains(MINUTES_AGO), F.coalesce(minutes, now))
               .when(s.contains(HOURS_AGO), F.coalesce(hours, now))
               .when(s.contains(TODAY), F.coalesce(today_time.cast("timestamp_ntz"),
                                                   F.when(today_hm == "", noon), now))
               .when(md != "", F.coalesce(with_year.cast("timestamp_ntz"), now))
               .otherwise(F.coalesce(full.cast("timestamp_ntz"), now)))
    return parsed


def parse_count_first_digits(s: Column) -> Column:
    """T9 (A): the first run of digits, else 0 (``1.2万`` -> 1)."""
    d = F.regexp_extract(F.coalesce(s, F.lit("")), r"(\d+)", 1)
    return F.when(d != "", d.try_cast("long")).otherwise(F.lit(0).cast("long"))


def parse_count(s: Column, compat: bool = False) -> Column:
    """T9 (B): ``x万`` -> x * 10,000 truncated, else the first digit run, else 0.

    Thousands separators are removed first and ``万`` amounts use decimal
    arithmetic (``1.13万`` -> 11300); ``compat=True`` multiplies in double
    (11299) and keeps separators as the original did.
    """
    t = F.trim(F.coalesce(s, F.lit("")))
    if not compat:
        t = F.regexp_replace(t, ",", "")
    num = F.trim(F.regexp_replace(t, TEN_THOUSAND, ""))
    if compat:
        wan = F.floor(num.try_cast("double") * 10000.0)
    else:
        wan = F.floor(num.try_cast("decimal(20,4)") * 10000)
    return (F.when(t.contains(TEN_THOUSAND), F.coalesce(wan.cast("long"), F.lit(0).cast("long")))
             .otherwise(parse_count_first_digits(t)))
