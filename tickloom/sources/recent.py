"""Polling a stored table for its newest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.filters import Moment, range_filter
from tickloom.operators.ordering import Order, head, sort_multi
from tickloom.session import list_dir


def recent_slice(
    df: DataFrame,
    ts: str,
    span: str,
    columns: Sequence[str] = (),
    as_of: Moment = None,
    order: Sequence[Order] = (),
    limit: int | None = None,
) -> DataFrame:
    """The rows of the last ``span`` before ``as_of`` (now if not given), in order.

    Filter, projection and limit reach the source, be it files or a database.
    """
    kept = range_filter(df, ts, span if span.startswith("-") else f"-{span}", as_of=as_of)
    if order:
        kept = sort_multi(kept, order)
    if columns:
        kept = kept.select(*columns)
    return kept if limit is None else kept.limit(limit)


def poll_new(df: DataFrame, ts: str, keys: Sequence[str], mark_path: str, most: int | None = None) -> DataFrame:
    """The rows that have come since the last poll: those after the stored mark in the order (ts, keys).

    The mark is the greatest (ts, keys) handed out, null keys last; the ``ts`` bound is a plain filter, so it reaches the scan, which skips
    older files and row groups, and only rows at that very moment are compared by their keys. ``keys`` must be unique per moment.
    With ``most`` a poll takes the first so many rows after the mark. The mark moves with :func:`keep_mark`, after
    the rows have been dealt with, so a poll that breaks off is repeated. Rows that get an older time than
    the mark are not seen, as they are not by any source that reads on from where it stopped; null times neither.
    """
    at = [ts, *keys]
    rows = df.filter(F.col(ts).isNotNull())
    marks = [n for n in list_dir(df.sparkSession, mark_path) if n.startswith("mark=")]
    if marks:
        last = df.sparkSession.read.schema(df.select(*at).schema).parquet(f"{mark_path}/{marks[-1]}").first()
        bounds = [F.lit(v).cast(df.schema[c].dataType) for c, v in zip(at, last)]
        after = _place([F.col(c) for c in at]) > _place(bounds)
        rows = rows.filter((F.col(ts) >= bounds[0]) & after)
    return rows if most is None else head(rows, most, at)


def _place(values: Sequence[Column]) -> Column:
    """A row's place in the order, in which nulls come last as in ``order_columns``."""
    pairs = [part for v in values for part in (v.isNull(), v)]
    return F.struct(*[part.alias(f"c{i}") for i, part in enumerate(pairs)])


def keep_mark(polled: DataFrame, ts: str, keys: Sequence[str], mark_path: str) -> bool:
    """Move the mark behind the rows of a poll; False if there were none."""
    spark, at = polled.sparkSession, [ts, *keys]
    last = polled.select(*at).orderBy(*[F.col(c).desc_nulls_first() for c in at]).limit(1)
    number = len([n for n in list_dir(spark, mark_path) if n.startswith("mark=")])
    if not last.head(1):
        return False
    last.write.mode("overwrite").parquet(f"{mark_path}/mark={number:09d}")
    return True


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table. Needs the database's driver on the class path; not tested here.

    Pass partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel.
    """
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
