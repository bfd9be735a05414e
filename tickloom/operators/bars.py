"""Open/high/low/close/volume bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import bucket
from tickloom.functions.spans import column_type

# The bar widths on offer.
BAR_SPANS = {
    "1min": "1m", "5min": "5m", "15min": "15m", "30min": "30m", "60min": "60m",
    "daily": "1d", "weekly": "1w", "monthly": "1mo",
}


def resample_bars(
    df: DataFrame,
    ts: str,
    price: str,
    interval: str,
    series: Sequence[str] = (),
    volume: str | None = None,
    tie: Sequence[str] = (),
    bar: str = "bar",
) -> DataFrame:
    """Bars per series; ``tie`` columns order rows of the same moment. Volume is the row count if not given."""
    if interval not in BAR_SPANS:
        raise ValueError(f"interval is one of {', '.join(BAR_SPANS)}: {interval!r}")
    # One plain column keeps the bars in a hash aggregate.
    at = F.struct(ts, *tie) if tie else F.col(ts)
    size = F.sum(volume) if volume else F.count(F.lit(1))
    start = bucket(ts, BAR_SPANS[interval], column_type(df, ts))
    return (
        df.filter(F.col(ts).isNotNull() & F.col(price).isNotNull())
        .groupBy(*series, start.alias(bar))
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            size.alias("volume"),
        )
    )
