"""Formatting and parsing of prices, times, durations and symbols as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECOND = 1_000_000_000


def _div(x: Column, n: int) -> Column:
    return F.floor(x / n) if n < 2 else F.call_function("floor", x.cast("decimal(20,0)") / n).cast("long")


def price(x: Column) -> Column:
    """Four implied decimals."""
    return F.format_string("%d.%04d", _div(x, 10_000), x % 10_000)


def clock(ns: Column, millis: bool = False) -> Column:
    """HH:MM:SS, or with milliseconds."""
    s = _div(ns, _SECOND)
    parts = [_div(s, 3600), _div(s, 60) % 60, s % 60]
    return F.format_string("%02d:%02d:%02d.%03d", *parts, _div(ns, 1_000_000) % 1000) if millis else F.format_string("%02d:%02d:%02d", *parts)


def parse_clock(text: Column) -> Column:
    """HH:MM:SS to nanoseconds; null if it isn't one."""
    whole = text.rlike(r"^\d{1,2}:\d{2}:\d{2}$")
    p = F.split(text, ":")
    return F.when(whole, (p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")) * _SECOND)


def duration(ns: Column) -> Column:
    """Nanoseconds in the unit that leaves at least one digit before the point."""
    return (
        F.when(ns < 1_000, F.format_string("%d ns", ns.cast("long")))
        .when(ns < 1_000_000, F.format_string("%.2f us", ns / 1e3))
        .when(ns < _SECOND, F.format_string("%.2f ms", ns / 1e6))
        .otherwise(F.format_string("%.2f s", ns / 1e9))
    )


def symbol(x: Column) -> Column:
    return F.regexp_replace(x, "[ \\x00]+$", "")


def rate(messages: Column, seconds: Column) -> Column:
    """Messages a second; 0 without time."""
    return F.when(seconds > 0, messages / seconds).otherwise(0.0)
