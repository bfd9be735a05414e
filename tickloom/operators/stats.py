"""Shares, distinct values and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.points import mean as mean_of


def value_shares(df: DataFrame, name: str, categories: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """Rows per value and their percentage of all rows.

    ``categories`` lists values in a column of the same name that are shown even if they do not occur, with 0. Values
    that it does not list, and null, keep their share.
    """
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    # Added up from the counts, whose shuffle Spark then uses twice.
    total = counts.agg(F.sum("n").alias("total")).scalar()
    if categories is not None:
        listed = categories.select(F.col(name).alias("__listed")).distinct().withColumn("__shown", F.lit(True))
        joined = counts.join(listed, counts[name].eqNullSafe(listed["__listed"]), "full_outer")
        # Null is a value too, so the side that has a row decides, not the value.
        counts = joined.select(F.when(F.col("n").isNull(), F.col("__listed")).otherwise(F.col(name)).alias(name), "n")
    n = F.coalesce(F.col("n"), F.lit(0))
    share = F.round(F.try_divide(F.lit(100.0) * n, total.cast("double")), digits)
    return counts.select(name, n.alias("n"), F.coalesce(share, F.lit(0.0)).alias("percent"))


def distinct_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names).distinct()


def distinct_counts(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The number of distinct values of each column as ``n_<column>``."""
    return df.groupBy(*by).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in names])


def summary(df: DataFrame, ts: str, mean: Sequence[str] = (), total: Sequence[str] = ()) -> DataFrame:
    """Row count, first and last moment, means and totals, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
        *[mean_of(F.col(c)).alias(f"mean_{c}") for c in mean],
        *[F.sum(c).alias(f"total_{c}") for c in total],
    )


MAX_MEMBERS = 100_000


def members_by_group(df: DataFrame, group: str, member: str, name: str = "members", limit: int = MAX_MEMBERS) -> DataFrame:
    """Each group with the sorted array of its distinct members.

    Duplicates go first, in a distributed step. The largest group is then counted, and one with more
    than ``limit`` members is refused: an array has to fit a task. :func:`member_rows` has no bound.
    """
    pairs = df.select(group, member).filter(F.col(member).isNotNull()).distinct()
    largest = pairs.groupBy(group).count().agg(F.max("count").alias("n")).first()["n"]
    if largest and largest > limit:
        raise ValueError(f"a group has {largest} members, more than {limit}; use member_rows")
    return pairs.groupBy(group).agg(F.sort_array(F.collect_list(member)).alias(name))


def member_rows(df: DataFrame, group: str, member: str) -> DataFrame:
    """The distinct members of each group, one row each, sorted."""
    pairs = df.select(group, member).filter(F.col(member).isNotNull()).distinct()
    return pairs.orderBy(group, member)
