"""Shares of a total: normalised weights and integer parts that add up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.series import ROWS_PER_SLICE, group_totals


def normalise_weights(
    df: DataFrame, keys: Sequence[str], weight: str, name: str = "share", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Each weight divided by the sum of its group; null where that sum is zero."""
    summed = group_totals(df, keys, {"__sum": F.sum(weight)}, rows_per_slice)
    share = F.try_divide(F.col(weight).cast("double"), F.col("__sum").cast("double"))
    return summed.select(*df.columns, share.alias(name))


def equal_parts(df: DataFrame, total: str, count: str | int, part_no: str = "part_no", name: str = "part") -> DataFrame:
    """Every row becomes ``count`` rows whose whole-number parts add up to ``total``; the last takes the rest."""
    n = F.lit(count) if isinstance(count, int) else F.col(count)
    rows = df.filter(n >= 1).select("*", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias(part_no))
    each = _whole(F.col(total), n)
    rest = F.col(total) - each * (n - 1)
    return rows.select("*", F.when(F.col(part_no) == n, rest).otherwise(each).cast("bigint").alias(name))


def _whole(total: Column, n: Column) -> Column:
    total, n = total.cast("bigint"), n.cast("bigint")
    return F.call_function("div", total - F.pmod(total, n), n)


def random_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    total: str,
    weight: str,
    name: str = "part",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Split ``total`` over the rows of each group in proportion to ``weight``, in whole numbers.

    The last row by ``order`` (unique within the group) takes what rounding leaves over, all of it if the weights add up
    to 0. A null weight counts as 0.
    """
    sums = group_totals(df, keys, {"__sum": F.sum(weight), "__last": F.max(order)}, rows_per_slice)
    share = F.try_divide(F.col(weight).cast("double"), F.col("__sum").cast("double"))
    exact = F.coalesce(share, F.lit(0.0)) * F.col(total).cast("double")
    rounded = sums.withColumn("__part", F.bround(exact, 0).cast("bigint")).withColumn(
        "__is_last", F.col(order) == F.col("__last")
    )
    others = F.sum(F.when(F.col("__is_last"), F.lit(0)).otherwise(F.col("__part")))
    settled = group_totals(rounded, keys, {"__others": others}, rows_per_slice)
    part = F.when(F.col("__is_last"), F.col(total) - F.col("__others")).otherwise(F.col("__part"))
    return settled.select(*df.columns, part.cast("bigint").alias(name))
