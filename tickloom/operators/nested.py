"""Arrays to rows and days without gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_events(df: DataFrame, keys: Sequence[str], events: str, order: Sequence[str] = ()) -> DataFrame:
    """One row per element of an array of structs, with the struct's fields as columns; sorted if ``order`` names columns."""
    rows = df.select(*keys, F.inline(F.col(events)))
    return rows.orderBy(*order) if order else rows


def explode_values(df: DataFrame, keys: Sequence[str], values: str, name: str, position: str | None = None) -> DataFrame:
    """One row per array element, with its 0-based place if ``position`` names a column."""
    if position:
        return df.select(*keys, F.posexplode(values).alias(position, name))
    return df.select(*keys, F.explode(values).alias(name))


def calendar_spine(df: DataFrame, ts: str, day: str = "day", count: str = "n") -> DataFrame:
    """Every day from the first to the last with its number of rows, 0 on days without any."""
    daily = df.groupBy(F.to_date(ts).alias(day)).agg(F.count(F.lit(1)).alias(count)).filter(F.col(day).isNotNull())
    ends = daily.agg(F.min(day).alias("__lo"), F.max(day).alias("__hi")).filter("__lo IS NOT NULL")
    days = ends.select(F.explode(F.sequence("__lo", "__hi")).alias(day))
    return days.join(daily, day, "left").select(day, F.coalesce(F.col(count), F.lit(0)).alias(count))
