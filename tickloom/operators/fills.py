"""Parent orders to child rows, and daily bars to a typed table of fills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.draws import (
    as_unit, key_hash, key_unit, pick_literal, weighted_choice, weighted_from_arrays, with_draws,
)
from tickloom.functions.scalars import fill_price, limit_price, session_timestamp, side_from_sign
from tickloom.operators.filters import drop_zero, require_columns
from tickloom.operators.ordering import sequential_id
from tickloom.operators.series import signed_delta
from tickloom.operators.tables import enforce_schema, execution_costs, lookup_join

# Columns and types of the fills table.
FILLS_SCHEMA = T.StructType([
    T.StructField("trade_id", T.IntegerType()),
    T.StructField("trader", T.StringType()),
    T.StructField("desk", T.StringType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("security_name", T.StringType()),
    T.StructField("sector_gics", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("order_type", T.StringType()),
    T.StructField("order_qty", T.IntegerType()),
    T.StructField("order_status", T.StringType()),
    T.StructField("limit_price", T.FloatType()),
    T.StructField("qty", T.IntegerType()),
    T.StructField("price", T.FloatType()),
    T.StructField("trade_value", T.FloatType()),
    T.StructField("commission", T.FloatType()),
    T.StructField("exec_venue", T.StringType()),
    T.StructField("venue_fee", T.FloatType()),
    T.StructField("bid_price", T.FloatType()),
    T.StructField("ask_price", T.FloatType()),
    T.StructField("mid_price", T.FloatType()),
    T.StructField("spread_price", T.FloatType()),
    T.StructField("high_day", T.FloatType()),
    T.StructField("low_day", T.FloatType()),
    T.StructField("fund", T.StringType()),
    T.StructField("benchmark_index", T.StringType()),
])
# Weights of 1 to 10 child orders a day, order types, and statuses with their weights.
SLICE_WEIGHTS = (1, 2, 4, 7, 10, 14, 18, 20, 14, 10)
ORDER_TYPES = ("LIMIT", "MARKET", "ICEBERG", "FOK", "IOC")
ORDER_STATUSES = ("NEW", "PARTIALLY_FILLED", "FILLED", "CANCELLED")
STATUS_WEIGHTS = (0.1, 0.2, 0.65, 0.05)

JITTER = 0.3      # a child differs from an equal share by up to this part of it
FLIP_SHARE = 0.2  # children that go against the parent's side
SPREAD_RANGE = (0.0001, 0.001)  # of the closing price
MARGIN_RANGE = (0.001, 0.01)    # of the fill price


def order_slices(
    df: DataFrame,
    qty: str,
    count: Column | str,
    key: Column | str,
    jitter: float = JITTER,
    slice_no: str = "slice_no",
    name: str = "slice_qty",
) -> DataFrame:
    """Every parent row becomes min(count, qty) child rows of uneven size that add up to ``qty``.

    Child i ends at an equal share i/n of the quantity, moved by a draw from the key; its size is the
    distance to the end of child i-1. The sizes telescope to the parent and each is at least 1.
    """
    if not 0 <= jitter <= 0.5:
        raise ValueError("jitter lies between 0 and 0.5")
    count = F.col(count) if isinstance(count, str) else count
    key = F.col(key) if isinstance(key, str) else key
    whole = F.col(qty).cast("bigint")
    n = F.least(count.cast("bigint"), whole)
    rows = df.filter((whole > 0) & (count > 0)).select(
        "*", n.alias("__n"), F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias(slice_no)
    )
    parent = F.col(qty).cast("bigint")

    def end(i: Column) -> Column:
        unit = key_unit(F.concat_ws("|", key.cast("string"), i.cast("string")))
        moved = F.when((i == 0) | (i == F.col("__n")), F.lit(0.0)).otherwise((unit - F.lit(0.5)) * F.lit(jitter))
        share = (parent - F.col("__n")).cast("double") * (i.cast("double") + moved) / F.col("__n").cast("double")
        return F.floor(share)

    i = F.col(slice_no)
    size = F.lit(1).cast("bigint") + end(i) - end(i - F.lit(1).cast("bigint"))
    return rows.select(*df.columns, i.cast("int").alias(slice_no), size.alias(name))


def weighted_assign(
    df: DataFrame, key: str, choices: Sequence, weights: Sequence[float], name: str, slot: int = 0
) -> DataFrame:
    """Give each row a category in proportion to the weights, by the hash of its key."""
    return df.withColumn(name, weighted_choice(choices, weights, key_unit(key, slot)))


def weighted_assign_by(
    df: DataFrame, on: str, preferences: DataFrame, key: str, name: str, slot: int = 0
) -> DataFrame:
    """The same with weights per group: ``preferences`` has ``on`` and the arrays ``choices`` and ``weights``.

    One row per group on the right, so no row is multiplied by the join.
    """
    joined = lookup_join(df, preferences, on, {"choices": F.lit(None), "weights": F.lit(None)})
    picked = weighted_from_arrays("choices", "weights", key_unit(key, slot))
    return joined.select(*df.columns, picked.alias(name))


@dataclass(frozen=True)
class Desk:
    """Who trades where: the choices every fill draws from."""

    traders: Sequence[str]
    desks: Sequence[str]
    venues: Sequence[str]
    funds: Sequence[str]
    benchmarks: Sequence[str]


# Draws of a child row, by slot.
(TRADER, DESK, VENUE, FUND, BENCHMARK, TYPE, STATUS, FLIP, SECOND, SPREAD, MID, SLIP, MARGIN, PART) = range(14)
PREFERRED = {"trader": TRADER, "desk": DESK, "exec_venue": VENUE, "fund": FUND, "benchmark_index": BENCHMARK}


def fills_from_bars(
    bars: DataFrame,
    desk: Desk,
    trader_rates: DataFrame,
    venue_rates: DataFrame,
    scale: float = 0.01,
    extras: bool = False,
    number: bool = True,
    rows_per_slice: int | None = None,
    preferences: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Daily bars to fills: the change in volume becomes a parent order, cut into priced child orders.

    ``bars`` has date, symbol, high, low, close and volume, one row per symbol and day, and optionally
    name and sector. ``trade_value`` and the fees are those of the whole child order; ``extras`` adds
    ``parent_qty`` and ``fill_value``, the value of the quantity filled. ``number=False`` leaves
    ``trade_id`` null and with it the one step that has to write (see ``ordering.positions``).

    A symbol has at most one row per day, which bounds its series, so long ones are not looked for
    unless ``rows_per_slice`` says so.

    ``preferences`` maps a column of ``PREFERRED`` to a table with a symbol and its arrays ``choices`` and ``weights``, as
    for :func:`weighted_assign_by`. Symbols that it lacks draw evenly from ``desk``.
    """
    unknown = set(preferences or {}) - set(PREFERRED)
    if unknown:
        raise ValueError(f"no preferences for {sorted(unknown)}")
    require_columns(bars, ["date", "symbol", "high", "low", "close", "volume"])
    has = set(bars.columns)
    name = F.col("name") if "name" in has else F.lit(None).cast("string")
    sector = F.col("sector") if "sector" in has else F.lit(None).cast("string")
    days = bars.select(
        F.col("date").cast("date").alias("date"),
        "symbol",
        F.col("high").cast("double").alias("high"),
        F.col("low").cast("double").alias("low"),
        F.col("close").cast("double").alias("close"),
        "volume",
        F.coalesce(name, F.concat(F.col("symbol"), F.lit(" Corp."))).alias("security_name"),
        F.coalesce(sector, F.lit("Unknown")).alias("sector_gics"),
    )
    deltas = signed_delta(days, ["symbol"], ["date"], "volume", scale, "__delta", rows_per_slice)
    parents = drop_zero(deltas, "__delta").select(
        "*",
        F.abs(F.col("__delta")).alias("parent_qty"),
        F.concat_ws("|", "symbol", F.col("date").cast("string")).alias("__parent"),
    )
    parents = with_draws(parents, "__parent", 2, "__p").drop("__p0")
    count = weighted_choice(range(1, len(SLICE_WEIGHTS) + 1), SLICE_WEIGHTS, as_unit(F.col("__p1")))
    children = order_slices(parents, "parent_qty", count, "__parent", name="order_qty").drop("__p1")
    children = children.withColumn("__key", F.concat_ws("|", F.col("__parent"), F.col("slice_no").cast("string")))
    timed = children.withColumn("event_ts", session_timestamp("date", key_hash("__key", SECOND)))
    if number:
        # Numbered while the rows are slim; prices and choices follow from the key afterwards.
        timed = sequential_id(timed, ["event_ts", "symbol", "date", "slice_no"])
    else:
        timed = timed.withColumn("trade_id", F.lit(None))
    priced = _priced(with_draws(timed, "__key", PART + 1, "__d"), desk)
    for column, table in (preferences or {}).items():
        priced = _preferred(priced, table, column)
    costed = execution_costs(priced, trader_rates, venue_rates, qty="order_qty")
    table = costed.withColumn("fill_value", F.col("qty") * F.col("price"))
    schema = FILLS_SCHEMA
    if extras:
        more = [T.StructField("parent_qty", T.IntegerType()), T.StructField("fill_value", T.FloatType())]
        schema = T.StructType([*schema.fields, *more])
    return enforce_schema(table, schema)


def _preferred(drawn: DataFrame, preferences: DataFrame, column: str) -> DataFrame:
    """``column`` drawn by the weights of the row's symbol, with the draw that it had; else as it is."""
    joined = lookup_join(drawn, preferences, "symbol", {"choices": F.lit(None), "weights": F.lit(None)})
    picked = weighted_from_arrays("choices", "weights", as_unit(F.col(f"__d{PREFERRED[column]}")))
    return joined.withColumn(column, F.coalesce(picked, F.col(column))).select(drawn.columns)


def _priced(drawn: DataFrame, desk: Desk) -> DataFrame:
    """Child rows with their draws to orders with choices, quotes and prices."""

    def draw(slot: int) -> Column:
        return F.col(f"__d{slot}")

    def between(bounds: tuple[float, float], slot: int) -> Column:
        low, high = bounds
        return F.lit(low) + as_unit(draw(slot)) * F.lit(high - low)

    with_parent = side_from_sign("__delta")
    against = F.when(F.col("__delta") > 0, F.lit("SELL")).otherwise(F.lit("BUY"))
    chosen = drawn.select(
        "*",
        pick_literal(desk.traders, draw(TRADER)).alias("trader"),
        pick_literal(desk.desks, draw(DESK)).alias("desk"),
        pick_literal(desk.venues, draw(VENUE)).alias("exec_venue"),
        pick_literal(desk.funds, draw(FUND)).alias("fund"),
        pick_literal(desk.benchmarks, draw(BENCHMARK)).alias("benchmark_index"),
        pick_literal(ORDER_TYPES, draw(TYPE)).alias("order_type"),
        weighted_choice(ORDER_STATUSES, STATUS_WEIGHTS, as_unit(draw(STATUS))).alias("order_status"),
        F.when(as_unit(draw(FLIP)) < FLIP_SHARE, against).otherwise(with_parent).alias("side"),
        (F.col("close") * between(SPREAD_RANGE, SPREAD)).alias("__spread"),
    )
    middle = chosen.withColumn("__mid", F.col("close") + (as_unit(draw(MID)) * 2 - 1) * F.col("__spread"))
    half = F.col("__spread") / 2
    quoted = middle.select("*", (F.col("__mid") - half).alias("__bid"), (F.col("__mid") + half).alias("__ask"))
    slip = as_unit(draw(SLIP)) * F.col("__spread") * 0.5
    filled = quoted.withColumn("__price", fill_price("side", "__bid", "__ask", slip))
    part = F.pmod(draw(PART), F.col("order_qty") + 1)
    return filled.select(
        "*",
        F.bround("__price", 2).alias("price"),
        F.bround(limit_price("side", "__price", between(MARGIN_RANGE, MARGIN)), 2).alias("limit_price"),
        F.when(F.col("order_status") == "FILLED", F.col("order_qty")).otherwise(part).alias("qty"),
        F.bround("__bid", 2).alias("bid_price"),
        F.bround("__ask", 2).alias("ask_price"),
        F.bround("__mid", 2).alias("mid_price"),
        F.bround("__spread", 4).alias("spread_price"),
        F.col("high").alias("high_day"),
        F.col("low").alias("low_day"),
    )
