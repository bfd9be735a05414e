"""Operators that follow each series in order: deltas, counters, rolling means.

A plain window over the series key puts a whole series into one task, which fails when one key holds
a large part of the table. Here a key with more than ``rows_per_slice`` rows is cut into slices along
its order; a window then runs per (key, slice), and the little that has to cross a slice border (a
count, a last value) comes from a summary with one row per slice of a long key.

Where to cut is read off a sample: rows whose hash of key and order falls below a rate that gives
``SAMPLES`` rows per target slice. Every ``SAMPLES / 2``-th of them, in the order of all order columns, is
a splitter, and a row finds its slice among its key's splitters by binary search. So slices hold about half of
``rows_per_slice`` whatever the values look like: one date, equal moments, long common prefixes, nulls. A slice
of twice the target would need four times its share of an even hash. Only rows that agree in all order
columns stay together, so ``order`` has to be unique per key, as it has for repeatable results.

Keys are counted and sampled once, by two jobs when an operator is called, and the splitters are written to
the shared folder; they and the summaries are broadcast only if they are measured to be small. Where no
key is long, what is left is the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.tables import small_side
from tickloom.session import durable

ROWS_PER_SLICE = 2_000_000
SAMPLES = 200

SLICE = "__slice"


def ordinal(df: DataFrame, name: str) -> Column:
    """A double that never decreases along the ascending order of a column."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.StringType):
        # The first six bytes, in the byte order strings are sorted by.
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise ValueError(f"cannot slice by {name} of type {kind.simpleString()}")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Equality of key columns that also matches null with null."""
    condition = F.lit(True)
    for i, key in enumerate(keys):
        condition = condition & left[key].eqNullSafe(right[f"{prefix}{i}"])
    return condition


def renamed_keys(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({key: f"{prefix}{i}" for i, key in enumerate(keys)})


def splitters(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_slice: int) -> DataFrame:
    """The keys with more than ``rows_per_slice`` rows and an array of the places in their order to cut them at."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows_per_slice)
    long = renamed_keys(durable(counts.select(*keys)), keys, "__long")
    rate = min(1.0, SAMPLES / rows_per_slice)
    picked = df.select(*dict.fromkeys([*keys, *order])).filter(even_hash([*keys, *order]) < rate)
    side = small_side(long)
    sample = picked.join(side, same_keys(picked, side, keys, "__long"), "left_semi")
    every = max(1, round(rate * rows_per_slice / 2))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    chosen = sample.withColumn("__place", place).filter(F.col("__place") % every == 0)
    return chosen.groupBy(*keys).agg(F.sort_array(F.collect_list(_at(order))).alias("__cuts"))


def even_hash(columns: Sequence[str]) -> Column:
    """A number in [0, 1) from the values of a row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(29), *columns), 11).cast("double") / F.lit(float(1 << 53))


def _at(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])


def _cuts_below(cuts: Column, at: Column) -> Column:
    """How many of the ascending ``cuts`` are not above ``at``, by binary search."""
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(cuts) + 1)).cast("int"))

    def halved(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["lo"] + state["hi"], 1)
        below = F.get(cuts, middle) <= at
        open_ = state["lo"] < state["hi"]
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(state["lo"]).alias("lo"),
            F.when(open_ & ~below, middle).otherwise(state["hi"]).alias("hi"),
        )

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halved)["lo"]


@dataclass(frozen=True)
class Sliced:
    """Rows with a slice number (0 for short keys) and the marker ``__is_long``; ``long`` tells whether any key is."""

    rows: DataFrame
    keys: list[str]
    long: bool

    @property
    def pieces(self) -> list[str]:
        """The columns of a window that stays within a slice."""
        return [*self.keys, SLICE] if self.long else self.keys

    def summary(self, *aggs: Column) -> DataFrame:
        """One row per slice of the long keys."""
        return self.rows.filter("__is_long").groupBy(*self.keys, SLICE).agg(*aggs)

    def carried(self, carry: DataFrame, names: Sequence[str]) -> DataFrame:
        """The rows with what ``carry`` (keys, slice, names) holds for their slice; null in short keys."""
        if not self.long:
            kinds = {n: carry.schema[n].dataType for n in names}
            return self.rows.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items()})
        stored = durable(carry.select(*self.keys, SLICE, *names))
        side = small_side(renamed_keys(stored, self.keys, "__carry").withColumnRenamed(SLICE, "__carry_slice"))
        match = same_keys(self.rows, side, self.keys, "__carry") & (self.rows[SLICE] == side["__carry_slice"])
        joined = self.rows.join(side, match & self.rows["__is_long"], "left")
        return joined.select(*self.rows.columns, *names)


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_slice: int) -> Sliced:
    """``df`` cut into slices that increase along ``order``. Nulls sort first and NaN last, as in Spark."""
    cuts = durable(splitters(df, keys, order, rows_per_slice))
    if not cuts.head(1):
        return Sliced(df.withColumns({SLICE: F.lit(0).cast("bigint"), "__is_long": F.lit(False)}), list(keys), False)
    side = small_side(renamed_keys(cuts, keys, "__long"))
    joined = df.join(side, same_keys(df, side, keys, "__long"), "left")
    number = F.when(F.col("__cuts").isNotNull(), _cuts_below(F.col("__cuts"), _at(order))).otherwise(F.lit(0))
    rows = joined.select(*df.columns, number.cast("bigint").alias(SLICE), F.col("__cuts").isNotNull().alias("__is_long"))
    return Sliced(rows, list(keys), True)


def running_id(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: int = 0,
    name: str = "running_id",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """A counter within each series: ``start`` + 1, + 2, ... along ``order``, which must be unique per key."""
    cut = sliced(df, keys, order, rows_per_slice)
    return numbered_rows(cut, order, start, name).select(*df.columns, name)


def numbered_rows(cut: Sliced, order: Sequence[str], start: int, name: str, size: str | None = None) -> DataFrame:
    """The counter on rows that have their slices, and the number of rows of the series if ``size`` names it."""
    counts = cut.summary(F.count(F.lit(1)).alias("__rows"))
    series = Window.partitionBy(*cut.keys)
    earlier = series.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *cut.keys, SLICE, F.sum("__rows").over(earlier).alias("__offset"), F.sum("__rows").over(series).alias("__all")
    )
    piece = Window.partitionBy(*cut.pieces)
    number = F.row_number().over(piece.orderBy(*order)) + F.coalesce(F.col("__offset"), F.lit(0)) + F.lit(start)
    columns = [*cut.rows.columns, number.cast("bigint").alias(name)]
    if size is not None:
        columns.append(F.coalesce(F.col("__all"), F.count(F.lit(1)).over(piece)).alias(size))
    return cut.carried(offsets, ["__offset", "__all"]).select(*columns)


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str = "previous",
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """The value of the row before in the series; null on the first row. ``order`` must be unique per key.

    Without ``rows_per_slice`` no key is looked at for its length: for series known to be short.
    """
    if rows_per_slice is None:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    cut = sliced(df, keys, order, rows_per_slice)
    at = F.struct(*order)  # a null in a plain column would be passed over
    lasts = cut.summary(F.max_by(F.col(value), at).alias("__last"))
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    carry = lasts.select(*keys, SLICE, F.lag("__last").over(by_slice).alias("__before"))
    within = Window.partitionBy(*cut.pieces).orderBy(*order)
    previous = F.when(F.row_number().over(within) == 1, F.col("__before")).otherwise(F.lag(value).over(within))
    return cut.carried(carry, ["__before"]).select(*df.columns, previous.alias(name))


def latest_value(cut: Sliced, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The rows of ``cut`` with the newest ``value`` that is not null, the row's own included."""
    rows = cut.rows.withColumn("__seen", value)
    seen = Sliced(rows, cut.keys, cut.long)
    lasts = seen.summary(F.max_by("__seen", F.when(F.col("__seen").isNotNull(), F.struct(*order))).alias("__last"))
    earlier = Window.partitionBy(*cut.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(*cut.keys, SLICE, F.last("__last", True).over(earlier).alias("__before"))
    within = Window.partitionBy(*cut.pieces).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("__seen", True).over(within), F.col("__before"))
    return seen.carried(carry, ["__before"]).select(*cut.rows.columns, found.alias(name))


def signed_delta(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    scale: float = 0.01,
    name: str = "order_qty",
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Change of ``value`` from the row before, times ``scale``, rounded half to even; 0 on the first row."""
    before = previous_value(df, keys, order, value, "__previous", rows_per_slice)
    change = F.coalesce(F.col(value) - F.col("__previous"), F.lit(0)) * F.lit(scale)
    return before.select(*df.columns, F.bround(change, 0).cast("bigint").alias(name))


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    window: int = 10,
    name: str = "smooth",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Mean of the last ``window`` rows of the series, 0 until there are that many.

    A null inside the window gives 0, as a mean over an incomplete window.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    cut = sliced(df, keys, order, rows_per_slice)

    def smooth(partition: Sequence[str], by: Sequence[str]) -> Column:
        last = Window.partitionBy(*partition).orderBy(*by).rowsBetween(-(window - 1), 0)
        full = F.count(F.col(value)).over(last) == window
        return F.when(full, F.sum(F.col(value)).over(last).cast("double") / F.lit(window)).otherwise(F.lit(0.0)).alias(name)

    if not cut.long:
        return df.select(*df.columns, smooth(keys, order))
    short = cut.rows.filter(~F.col("__is_long")).select(*df.columns, smooth(keys, order))

    # Long series: number the rows, then cut by number into tiles that begin with a copy of the
    # window - 1 rows before them.
    tile_rows = max(rows_per_slice, 2 * window)
    numbered = numbered_rows(Sliced(cut.rows.filter("__is_long"), cut.keys, True), order, 0, "__at")
    own = F.floor((F.col("__at") - 1) / tile_rows)
    reach = F.floor((F.col("__at") - 1 + (window - 1)) / tile_rows)
    tiled = numbered.select("*", own.alias("__own"), F.explode(F.sequence(own, reach)).alias("__tile"))
    tiled = tiled.select("*", smooth([*keys, "__tile"], ["__at"]))
    long = tiled.filter(F.col("__tile") == F.col("__own")).select(*df.columns, name)
    return short.unionByName(long)


def log_rank_weights(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    low: float = 0.1,
    name: str = "weight",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Weights from 1 down to ``low``, evenly spaced on a log scale by position within the group."""
    cut = sliced(df, keys, order, rows_per_slice)
    counted = numbered_rows(cut, order, 0, "__at", "__size")
    share = (F.col("__at") - 1) / (F.col("__size") - 1)
    weight = F.when(F.col("__size") == 1, F.lit(1.0)).otherwise(F.pow(F.lit(float(low)), share))
    return counted.select(*df.columns, weight.alias(name))


def group_totals(
    df: DataFrame, keys: Sequence[str], totals: dict[str, Column], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Every row with aggregates of its group.

    Short groups meet in one window. Rows of long groups do not meet at all: they take their totals, aggregated
    beforehand, from a join with at most rows/rows_per_slice groups.
    """
    ready = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[agg.alias(f"__total_{name}") for name, agg in totals.items()]
    )
    ready = durable(renamed_keys(ready.filter(F.col("__n") > rows_per_slice), keys, "__long"))
    group = Window.partitionBy(*keys)
    apart = [agg.over(group).alias(name) for name, agg in totals.items()]
    if not ready.head(1):
        return df.select(*df.columns, *apart)
    side = small_side(ready)
    joined = df.join(side, same_keys(df, side, keys, "__long"), "left")
    long = joined.filter(F.col("__n").isNotNull()).select(*df.columns, *[F.col(f"__total_{n}").alias(n) for n in totals])
    short = joined.filter(F.col("__n").isNull()).select(*df.columns, *apart)
    return short.unionByName(long)
