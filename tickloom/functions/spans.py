"""Time spans written as text: ``-7d``, ``1h30m``, ``1y``."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECE = re.compile(r"(\d+)\s*(us|ms|mo|s|m|h|d|w|y)")
_WHOLE = re.compile(r"^\s*([+-]?)\s*((?:\d+\s*(?:us|ms|mo|s|m|h|d|w|y)\s*)+)$")

# Microseconds of the units that have a fixed length.
FIXED_UNITS = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "m": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
    "w": 604_800_000_000,
}
# Months of the units that do not.
CALENDAR_UNITS = {"mo": 1, "y": 12}

_LONG_UNITS = [
    (r"microseconds?", "us"),
    (r"milliseconds?", "ms"),
    (r"seconds?|secs?", "s"),
    (r"minutes?|mins?", "m"),
    (r"hours?|hrs?", "h"),
    (r"days?", "d"),
    (r"weeks?", "w"),
    (r"months?", "mo"),
    (r"years?", "y"),
]


def parse_span(text: str) -> tuple[int, int]:
    """A span as (months, microseconds), negative for a leading minus.

    Units: us ms s m h d w mo y, ``m`` being minutes; full English names are accepted too.
    """
    short = text.lower()
    for pattern, unit in _LONG_UNITS:
        short = re.sub(rf"(?<=[\d\s])(?:{pattern})\b", unit, short)
    match = _WHOLE.match(short)
    if not match:
        raise ValueError(f"not a time span: {text!r}")
    sign = -1 if match.group(1) == "-" else 1
    months = micros = 0
    for number, unit in _PIECE.findall(match.group(2)):
        if unit in CALENDAR_UNITS:
            months += int(number) * CALENDAR_UNITS[unit]
        else:
            micros += int(number) * FIXED_UNITS[unit]
    return sign * months, sign * micros


def span_interval(text: str) -> Column:
    """A span as an interval column."""
    months, micros = parse_span(text)
    return F.make_interval(months=F.lit(months), secs=(F.lit(micros) / F.lit(1_000_000)).cast("decimal(18,6)"))


def fixed_micros(text: str) -> int:
    """The length of a span of fixed-length units; months and years are refused."""
    months, micros = parse_span(text)
    if months or micros <= 0:
        raise ValueError(f"need a positive span of fixed length: {text!r}")
    return micros


def instant(value: Column | datetime | date | str | None, like: str) -> Column:
    """A moment as a column of the type ``like``; none means now."""
    if value is None:
        return F.current_timestamp().cast(like)
    if isinstance(value, Column):
        return value.cast(like)
    return F.lit(str(value)).cast(like)


def column_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def latest(df: DataFrame, ts: str) -> datetime | None:
    """The newest moment in a column: one row to the driver, so it can be a pushed-down literal."""
    return df.agg(F.max(ts).cast("string").alias("m")).first()["m"]
