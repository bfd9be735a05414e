"""Outage masking: a countdown per station that starts at a trigger and blanks the rows after it.

A trigger inside an outage counts for nothing, so whether one counts depends on all before it. That is settled among
the triggers alone, in column functions: with rows numbered along each station, a trigger at row r of duration d frees row
r + d + 1. One that no earlier trigger of its station reaches counts for certain. From there each trigger points to
the first one at or after the row it frees, and those on the way from a certain one count; pointers are doubled, so the
rounds grow with the logarithm of the longest chain of outages that follow on one another.

Rows stay in the JVM: they are numbered, and take the newest trigger that counts, in windows over slices of a station (see
``series``), so a station may hold any part of the table. Every round is written to the shared folder, and one
row per round comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import ROWS_PER_SLICE, SLICE, Sliced, latest_value, numbered_rows, sliced
from tickloom.operators.tables import small_side
from tickloom.session import durable

AT, FREE, STATION = "__at", "__free", "__station"


def mask_outages(
    df: DataFrame,
    station: str,
    order: Sequence[str],
    trigger: str,
    readings: Sequence[str],
    status: str = "status",
    rows_per_slice: int = ROWS_PER_SLICE,
    start: DataFrame | None = None,
) -> DataFrame:
    """Blank the readings of each station during outages and add a fault/normal status.

    ``trigger`` holds the duration of an outage in rows on the row that starts it, else null or 0. The
    trigger row is a fault but keeps its values, the rows after it are masked, and the last of those is no longer a
    fault. ``order`` is unique per station. ``start`` (station, left) tells how many rows of an earlier outage are left.
    """
    rows = outage_rows(df, station, order, trigger, rows_per_slice, start)
    _, fault = in_outage()
    return rows.select(*masked_columns(df, readings), F.when(fault, "fault").otherwise("normal").alias(status))


def masked_columns(df: DataFrame, readings: Sequence[str]) -> list[Column]:
    """The columns of ``df``, with the readings blanked in an outage."""
    masked, _ = in_outage()
    zeroed = {c: F.when(masked, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in readings}
    return [zeroed.get(c, F.col(c)) for c in df.columns]


def in_outage() -> tuple[Column, Column]:
    """(masked, fault) of a row of ``outage_rows``."""
    at, begun, free = F.col(AT), F.col("__outage")[AT], F.col("__outage")[FREE]
    return F.coalesce((at > begun) & (at < free), F.lit(False)), F.coalesce((at >= begun) & (at < free - 1), F.lit(False))


def outage_rows(
    df: DataFrame, station: str, order: Sequence[str], trigger: str, rows_per_slice: int = ROWS_PER_SLICE, start: DataFrame | None = None
) -> DataFrame:
    """``df`` with ``__at``, the row's number in its station from 1, and ``__outage``, (row, free row) of the newest trigger that counts."""
    cut = sliced(df, [station], order, rows_per_slice)
    numbered = numbered_rows(cut, order, 0, AT)
    duration = F.col(trigger).cast("bigint")
    triggers = numbered.filter(duration > 0).select(F.col(station).alias(STATION), AT, (F.col(AT) + 1 + duration).alias(FREE))
    if start is not None:
        left = start.filter("left > 0").select(F.col(station).alias(STATION), F.lit(0).cast("bigint").alias(AT), (F.col("left") + 1).alias(FREE))
        triggers = triggers.unionByName(left)
    side = accepted_triggers(triggers, rows_per_slice).withColumnsRenamed({AT: "__begun"})
    side = small_side(side)
    match = numbered[station].eqNullSafe(side[STATION]) & (numbered[AT] == side["__begun"])
    begun = F.when(F.col("__begun").isNotNull(), F.struct(F.col("__begun").alias(AT), F.col(FREE).alias(FREE)))
    flagged = numbered.join(side, match, "left").select(*numbered.columns, begun.alias("__begins"))
    found = latest_value(Sliced(flagged, cut.keys, cut.long), order, F.col("__begins"), "__outage")
    if start is not None:
        first = small_side(left.withColumnsRenamed({STATION: "__first", FREE: "__first_free"}).drop(AT))
        found = found.join(first, found[station].eqNullSafe(first["__first"]), "left")
        earlier = F.when(F.col("__first_free").isNotNull(), F.struct(F.lit(0).cast("bigint").alias(AT), F.col("__first_free").alias(FREE)))
        found = found.withColumn("__outage", F.coalesce("__outage", earlier))
    return found.select(*df.columns, AT, "__outage")


def accepted_triggers(triggers: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Those of the triggers (station, row, free row) that do not lie in the outage of another that counts."""
    nodes = durable(triggers)
    cut = sliced(nodes, [STATION], [AT], rows_per_slice)
    earlier = Window.partitionBy(*cut.pieces).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    reach = cut.summary(F.max(FREE).alias("__reach"))
    before = Window.partitionBy(STATION).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.select(STATION, SLICE, F.max("__reach").over(before).alias("__reach"))
    reached = F.greatest(F.max(FREE).over(earlier), F.col("__reach"), F.lit(0).cast("bigint"))
    nodes = durable(cut.carried(reach, ["__reach"]).select(STATION, AT, FREE, (reached <= F.col(AT)).alias("__sure")))
    marked = nodes.filter("__sure").select(STATION, AT)
    jumps = durable(_next_triggers(nodes, rows_per_slice))
    while jumps.head(1):
        there = jumps.withColumnsRenamed({STATION: "__s", AT: "__a"})
        match = [F.col(STATION).eqNullSafe(F.col("__s")), F.col(AT) == F.col("__a")]
        marked = durable(marked.unionByName(marked.join(there, match).select(STATION, F.col("__to").alias(AT))))
        further = there.withColumnRenamed("__to", "__beyond")
        match = [F.col(STATION).eqNullSafe(F.col("__s")), F.col("__to") == F.col("__a")]
        jumps = durable(jumps.join(further, match).select(STATION, AT, F.col("__beyond").alias("__to")))
    side = marked.withColumnsRenamed({STATION: "__s", AT: "__a"})
    return nodes.join(side, [nodes[STATION].eqNullSafe(side["__s"]), nodes[AT] == side["__a"]], "left_semi").select(STATION, AT, FREE)


def _next_triggers(nodes: DataFrame, rows_per_slice: int) -> DataFrame:
    """(station, row, to): the first trigger at or after the row that a trigger frees, unless that one counts for certain."""
    points = nodes.select(STATION, (-F.col(AT)).alias("__x"), F.lit(0).alias("__kind"), AT, "__sure")
    asking = nodes.select(STATION, (-F.col(FREE)).alias("__x"), F.lit(1).alias("__kind"), AT, "__sure")
    order = ["__x", "__kind", AT]  # backwards, a trigger before those that ask for its row
    cut = sliced(points.unionByName(asking), [STATION], order, rows_per_slice)
    found = latest_value(cut, order, F.when(F.col("__kind") == 0, F.struct(AT, "__sure")), "__next")
    return found.filter((F.col("__kind") == 1) & ~F.col("__next")["__sure"]).select(STATION, AT, F.col("__next")[AT].alias("__to"))
