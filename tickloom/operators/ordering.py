"""Sorting, the newest rows, and numbering a whole table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.draws import HASH_RANGE, key_hash
from tickloom.operators.series import ordinal
from tickloom.session import durable

Order = str | tuple[str, str]


def order_columns(order: Sequence[Order]) -> list[Column]:
    """``["ts", ("ticker", "desc")]`` as sort columns; nulls come last either way."""
    columns = []
    for item in order:
        name, direction = (item, "asc") if isinstance(item, str) else item
        if direction not in ("asc", "desc"):
            raise ValueError(f"sort direction is 'asc' or 'desc': {direction!r}")
        columns.append(F.col(name).asc_nulls_last() if direction == "asc" else F.col(name).desc_nulls_last())
    return columns


def sort_multi(df: DataFrame, order: Sequence[Order]) -> DataFrame:
    """Sort by several columns in mixed directions."""
    return df.orderBy(*order_columns(order))


def latest_n(df: DataFrame, ts: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows.

    For a date or timestamp a first job counts rows per day, reading that column only, and finds the
    day the n-th row falls on. The sort then sees the rows from that day on, and the scan skips the
    files before it, where otherwise every task would send ``n`` rows to the last one.
    """
    kind = df.schema[ts].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        per_day = df.filter(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).count()
        # Each of these days has a row, so n of them are enough.
        seen, first = 0, None
        for day in per_day.orderBy(F.col("day").desc()).limit(n).collect():
            seen, first = seen + day["count"], day["day"]
            if seen >= n:
                break
        if seen >= n:
            df = df.filter(F.col(ts) >= F.lit(str(first)).cast(kind))
    return df.orderBy(F.col(ts).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tie]).limit(n)


# Up to this many rows Spark's own top-k is fine, where every task sends its first n to one task.
TOP_ROWS = 1000


def _narrowed(df: DataFrame, order: Order, n: int) -> DataFrame:
    """``df`` without rows that cannot be among the first ``n``, found from an estimated quantile.

    Two jobs read the order column. The bound is checked: unless ``n`` rows lie within it, all are kept.
    """
    name, direction = (order, "asc") if isinstance(order, str) else order
    if not isinstance(df.schema[name].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df
    position = ordinal(df, name)
    total = df.count()
    if total < 10 * n:
        return df
    share = 2 * n / total + 1e-4
    quantile = F.percentile_approx(position, share if direction == "asc" else 1 - share, 10_000)
    bound = df.agg(quantile.alias("b")).first()["b"]
    if bound is None:
        return df
    kept = df.filter(position <= F.lit(bound) if direction == "asc" else position >= F.lit(bound))
    return kept if kept.count() >= n else df


def head(df: DataFrame, n: int, order: Sequence[Order] = ()) -> DataFrame:
    """The first ``n`` rows, by ``order`` if one is given."""
    if not order:
        return df.limit(n)
    rows = _narrowed(df, order[0], n) if n > TOP_ROWS else df
    return sort_multi(rows, order).limit(n)


def sample_n(df: DataFrame, n: int, key: str) -> DataFrame:
    """``n`` rows picked by the hash of a unique key: the same ones every time."""
    if n > TOP_ROWS:
        # Hashes are even, so the bound is known from the row count; it is checked all the same.
        total = df.count()
        if total > 10 * n:
            bound = math.ceil(HASH_RANGE * (n + 10 * math.sqrt(n)) / total)
            few = df.filter(key_hash(key) < F.lit(bound).cast("bigint"))
            df = few if few.count() >= n else df
    return df.orderBy(key_hash(key), F.col(key)).limit(n)


def numbered(df: DataFrame, name: str = "position") -> DataFrame:
    """Rows numbered from 0 in the order of the partitions and of the rows in them, as after a sort.

    The partitions are written to the shared folder once: the borders of a sort are sampled, and a lost
    executor must not lead to other borders. A row's number is then the rows in the partitions before
    plus its place in its own, with one count per partition on the driver.
    """
    # The partition number is in the upper bits of this id and the place within it in the lower 33.
    placed = durable(df).withColumn("__place", F.monotonically_increasing_id())
    part = F.shiftright(F.col("__place"), 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, before = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(p, 0)
    starts = F.array(*[F.lit(o).cast("bigint") for o in offsets or [0]])
    place = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
    return placed.withColumn(name, F.get(starts, part.cast("int")) + place).drop("__place")


def positions(df: DataFrame, order: Sequence[Order], name: str = "position", partitions: int | None = None) -> DataFrame:
    """Rows numbered from 0 along a global order, which must be unique.

    The table is range-partitioned by the order, so no task holds more than its share whatever the values.
    """
    columns = order_columns(order)
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered(df.repartitionByRange(count, *columns).sortWithinPartitions(*columns), name)


def sequential_id(
    df: DataFrame, order: Sequence[Order], first: int = 10_001, name: str = "trade_id", partitions: int | None = None
) -> DataFrame:
    """Consecutive ids along a unique global order."""
    numbered = positions(df, order, "__position", partitions)
    return numbered.withColumn(name, F.col("__position") + F.lit(first).cast("bigint")).drop("__position")
