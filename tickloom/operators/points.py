"""Wide rows to time-series points (one row per field) and back, and window aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import bucket, epoch_ns
from tickloom.functions.spans import column_type, fixed_micros, parse_span

MAX_FIELDS = 1000


def to_points(
    df: DataFrame,
    measurement: str,
    timestamp: str,
    tags: Sequence[str],
    fields: Sequence[str],
    zone: str | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per field with ``_measurement``, the tags, ``_field``, ``_value``, ``_svalue``, ``_time``, ``_time_ns``.

    Numbers go to ``_value``, text to ``_svalue``; a null field makes no point. ``zone`` is the zone
    of a wall-clock timestamp, none meaning UTC. ``extra`` columns are kept as they are.
    """
    ts = F.col(timestamp).cast("timestamp")
    if zone:
        ts = F.to_utc_timestamp(ts, zone)
    pieces = []
    for field in fields:
        text = isinstance(df.schema[field].dataType, T.StringType)
        pieces.append(
            F.struct(
                F.lit(field).alias("_field"),
                (F.lit(None) if text else F.col(field)).cast("double").alias("_value"),
                (F.col(field) if text else F.lit(None)).cast("string").alias("_svalue"),
            )
        )
    base = df.select(
        F.lit(measurement).alias("_measurement"),
        *[F.col(t).cast("string").alias(t) for t in tags],
        *extra,
        ts.alias("_time"),
        epoch_ns(ts).alias("_time_ns"),
        F.explode(F.array(*pieces)).alias("__point"),
    )
    points = base.select(*base.columns[:-1], "__point.*")
    return points.filter(F.col("_value").isNotNull() | F.col("_svalue").isNotNull())


def field_names(points: DataFrame, field: str = "_field", limit: int = MAX_FIELDS) -> list[str]:
    """The distinct field names, at most ``limit`` of them on the driver; more is an error."""
    rows = points.select(field).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct values in {field}")
    return sorted(r[0] for r in rows if r[0] is not None)


def field_types(points: DataFrame, field: str = "_field", text: str = "_svalue", limit: int = MAX_FIELDS) -> dict[str, str]:
    """The fields and whether they hold text or numbers; more than ``limit`` are an error."""
    kinds = points.groupBy(field).agg(F.count(text).alias("texts")).filter(F.col(field).isNotNull())
    rows = kinds.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct values in {field}")
    return {r[field]: "string" if r["texts"] else "double" for r in sorted(rows, key=lambda r: r[field])}


def pivot_fields(
    points: DataFrame,
    row_key: Sequence[str],
    fields: Sequence[str] | Mapping[str, str] | None = None,
    field: str = "_field",
    value: str = "_value",
    order: str | None = None,
    text: str = "_svalue",
    limit: int = MAX_FIELDS,
) -> DataFrame:
    """Points back to wide rows: one per ``row_key`` (the time and the tags), one column per field.

    Of several points for a field the newest by ``order`` counts, without one the largest value. ``fields`` maps names to
    types: ``string`` comes from the column ``text``, every other type is cast from ``value`` (longs are exact up to
    2**53, as a point holds a double). A list of names means numbers. Naming the fields saves a job; without names, a field
    with any text is text, and more than ``limit`` fields are an error.
    """
    if fields is None:
        fields = field_types(points, field, text, limit) if text in points.columns else field_names(points, field, limit)
    types = dict(fields) if isinstance(fields, Mapping) else {name: None for name in fields}

    def cell(name: str, kind: str | None) -> Column:
        held = F.when(F.col(field) == name, F.col(text if kind == "string" else value))
        if order is None:
            found = F.max(held)
        else:
            found = F.max(F.when(F.col(field) == name, F.struct(F.col(order).alias("o"), held.alias("v"))))["v"]
        return (found if kind in (None, "string") else found.cast(kind)).alias(name)

    return points.groupBy(*row_key).agg(*[cell(n, k) for n, k in types.items()])


def mean(c: Column) -> Column:
    """Sum over count, which keeps the sum of decimals exact."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


WINDOW_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "mean": mean, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
}


def aggregate_window(
    df: DataFrame,
    ts: str,
    every: str,
    series: Sequence[str],
    value: str = "_value",
    fn: str = "mean",
    stamp: str = "start",
    name: str | None = None,
) -> DataFrame:
    """One aggregate per series and time window; windows without rows give none.

    ``stamp`` picks the window's start or end as its time.
    """
    if fn not in WINDOW_FUNCTIONS:
        raise ValueError(f"fn is one of {sorted(WINDOW_FUNCTIONS)}")
    kind = column_type(df, ts)
    start = bucket(ts, every, kind)
    rows = df.filter(F.col(ts).isNotNull()).groupBy(*series, start.alias(ts))
    result = rows.agg(WINDOW_FUNCTIONS[fn](F.col(value)).alias(name or value))
    if stamp == "start":
        return result
    if stamp != "end":
        raise ValueError("stamp is 'start' or 'end'")
    months, _ = parse_span(every)
    if months:
        moved = F.add_months(F.col(ts), months)
    else:
        moved = F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) + F.lit(fixed_micros(every)).cast("bigint"))
    return result.withColumn(ts, moved.cast(kind))
