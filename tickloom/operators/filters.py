"""Row filters and input checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.spans import column_type, instant, parse_span, span_interval

Moment = Column | datetime | date | str | None


def filter_eq(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows whose columns equal the given values; pushed down to the scan."""
    for name, value in values.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def range_filter(df: DataFrame, ts: str, start: str, stop: str | None = None, as_of: Moment = None) -> DataFrame:
    """Rows from ``as_of`` + ``start`` (inclusive) up to ``as_of`` + ``stop`` (exclusive).

    Both are spans such as ``-7d``; a positive one lies after ``as_of``, which defaults to now.
    """
    kind = column_type(df, ts)
    now = instant(as_of, kind)
    kept = df.filter(F.col(ts) >= (now + span_interval(start)).cast(kind))
    if stop is not None:
        kept = kept.filter(F.col(ts) < (now + span_interval(stop)).cast(kind))
    return kept


def time_span_filter(df: DataFrame, ts: str, span: str | None, as_of: Moment = None) -> DataFrame:
    """Rows from the midnight that lies ``span`` back; the sign is optional and nonsense means one year."""
    try:
        months, micros = parse_span(span or "")
    except ValueError:
        months, micros = parse_span("365d")
    kind = column_type(df, ts)
    back = F.make_interval(
        months=F.lit(-abs(months)), secs=(F.lit(-abs(micros)) / F.lit(1_000_000)).cast("decimal(18,6)")
    )
    start = F.date_trunc("day", (instant(as_of, kind) + back).cast("timestamp")).cast(kind)
    return df.filter(F.col(ts) >= start)


def filter_any(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Rows whose column is one of the values."""
    return df.filter(F.col(name).isin(list(values)))


def drop_zero(df: DataFrame, qty: str, signed: bool = True) -> DataFrame:
    """Drop zero quantities, and negative ones too when ``signed`` is false."""
    return df.filter(F.col(qty) != 0) if signed else df.filter(F.col(qty) > 0)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail at once if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


# How a market-data provider words its errors, with the reason to report.
ERROR_PATTERNS = (
    (r'"Information":\s*".*rate limit.*premium.*"', "rate limit"),
    (r'"Error[^"]*"\s*:', "error"),
)


def with_error_reason(
    df: DataFrame, text: str, patterns: Sequence[tuple[str, str]] = ERROR_PATTERNS, name: str = "reason"
) -> DataFrame:
    """The reason of the first pattern found in the text, null for a good payload."""
    reason = F.lit(None).cast("string")
    for pattern, label in reversed(patterns):
        reason = F.when(F.col(text).rlike(pattern), F.lit(label)).otherwise(reason)
    return df.withColumn(name, reason)


def reject_error_payloads(
    df: DataFrame, text: str, patterns: Sequence[tuple[str, str]] = ERROR_PATTERNS
) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows; the rejected ones carry a ``reason``."""
    marked = with_error_reason(df, text, patterns)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")
