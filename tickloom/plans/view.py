"""A view config (a dict) to a DataFrame.

    {"group_by": ["ticker"], "split_by": ["client"], "columns": ["open", "timestamp", "client"],
     "aggregates": {"open": "mean", "timestamp": "last", "client": "dominant"},
     "filter": [["open", ">", 0]], "sort": [["open", "desc"]],
     "expressions": {"minute": "bucket(\\"timestamp\\", '1m')"}}

The result has one row per group of every level: ``__level`` 0 is the total, level i groups by the
first i keys, and the keys below a row's level are null. With ``split_by`` every column appears once
per split value as ``<value>|<column>``.

How it runs: the table is aggregated once at the finest grain, groups times split values, keeping
values that can be merged (sums, counts, extremes, the newest value). Levels and split columns are
then built from that small result, so raw rows are neither copied per level nor tested per split
value. ``streaming.maintained`` stores these parts and merges batches into them.

``last`` of a text, or by several order columns, would make Spark sort the rows, as its hash
aggregation holds neither. So a hash aggregation first finds the newest moment per group, a join keeps
the few rows of those moments, and only these are compared further.

``dominant`` counts each value per group as a distributed aggregation of its own, so a column with
very many values needs no map in memory. Where there are very many, most cannot win: rows are first
counted per group and hash of the value, which bounds every value from above; the values of each
group's fullest hash are counted exactly, which bounds the winner from below; and only values whose
hash reaches that bound are counted at all.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import bucket
from tickloom.functions.spans import column_type
from tickloom.operators.tables import small_side
from tickloom.session import durable

MAX_SPLITS = 1000
LEVEL = "__level"
# From this many distinct values in groups on, `dominant` counts hashes first, so many per group.
PRUNE_FROM = 2_000_000
PRUNE_HASHES = 4096

# Keys of a config that describe the screen, not the data.
DISPLAY_KEYS = {"version", "plugin", "plugin_config", "columns_config", "settings", "theme", "title", "table"}
DATA_KEYS = {"group_by", "split_by", "columns", "filter", "sort", "expressions", "aggregates"}
AGGREGATES = {"mean", "avg", "max", "min", "count", "sum", "last", "dominant"}

_BUCKET = re.compile(r"""^\s*bucket\(\s*["`]?([^"`',]+?)["`]?\s*,\s*'(\d*)\s*([A-Za-z]+)'\s*\)\s*$""")


def q(name: str) -> Column:
    """A column by its exact name, dots and dashes included."""
    return F.col("`" + name.replace("`", "``") + "`")


# --- filters and expressions ---------------------------------------------------------------


def filter_column(condition: Sequence) -> Column:
    """``[column, op, value]`` as a condition."""
    if len(condition) not in (2, 3):
        raise ValueError(f"a filter is [column, op, value]: {condition!r}")
    c, op = q(condition[0]), condition[1].strip().lower()
    if op == "is null":
        return c.isNull()
    if op == "is not null":
        return c.isNotNull()
    if len(condition) != 3:
        raise ValueError(f"{op!r} needs a value")
    value = condition[2]
    if op in ("in", "not in"):
        return c.isin(list(value)) if op == "in" else ~c.isin(list(value))
    text = c.cast("string")
    operations = {
        "==": lambda: c == F.lit(value),
        "!=": lambda: c != F.lit(value),
        ">": lambda: c > F.lit(value),
        ">=": lambda: c >= F.lit(value),
        "<": lambda: c < F.lit(value),
        "<=": lambda: c <= F.lit(value),
        "contains": lambda: text.contains(str(value)),
        "begins with": lambda: text.startswith(str(value)),
        "ends with": lambda: text.endswith(str(value)),
    }
    if op not in operations:
        raise ValueError(f"unknown filter operator {condition[1]!r}")
    return operations[op]()


def expression_column(df: DataFrame, text: str) -> Column:
    """``bucket("column", '1m')``, or any Spark SQL expression."""
    match = _BUCKET.match(text)
    if not match:
        return F.expr(text)
    name, number, unit = match.groups()
    return bucket(q(name), f"{number or 1}{unit}", column_type(df, name))


# --- aggregates as mergeable parts ------------------------------------------------------------


class _Measure:
    """One output column: its parts at the finest grain, how they merge, and the final value."""

    def __init__(self, index: int, column: str, how: str, order: Sequence[str]):
        self.column, self.how, self.order = column, how, order
        self.a, self.b, self.t = f"__a{index}", f"__b{index}", f"__t{index}"

    def parts(self) -> list[Column]:
        c = q(self.column)
        if self.how in ("mean", "sum"):
            # The count tells a sum of nothing, which is null, from one that came to 0 when rows left.
            return [F.sum(c).alias(self.a), F.count(c).alias(self.b)]
        if self.how == "last" and len(self.order) == 1:
            at = F.when(c.isNotNull(), q(self.order[0]))
            return [F.max_by(c, at).alias(self.a), F.max(at).alias(self.b)]
        if self.how == "last":
            at = [q(o).alias(f"o{i}") for i, o in enumerate(self.order)]
            newest = F.max(F.when(c.isNotNull(), F.struct(*at, c.alias("v"))))
            return [newest.alias(self.a)]
        return [{"count": F.count, "max": F.max, "min": F.min}[self.how](c).alias(self.a)]

    def renamed(self, column: str) -> _Measure:
        """The same parts from another column."""
        other = _Measure(0, column, self.how, self.order)
        other.a, other.b = self.a, self.b
        return other

    def moment(self) -> Column:
        """The newest moment by the first order column."""
        return F.max(F.when(q(self.column).isNotNull(), q(self.order[0]))).alias(self.t)

    def merged(self) -> list[Column]:
        if self.how in ("mean", "sum"):
            return [F.sum(self.a).alias(self.a), F.sum(self.b).alias(self.b)]
        if self.how == "last" and len(self.order) == 1:
            return [F.max_by(self.a, self.b).alias(self.a), F.max(self.b).alias(self.b)]
        merge = {"count": F.sum, "max": F.max, "min": F.min, "last": F.max}[self.how]
        return [merge(F.col(self.a)).alias(self.a)]

    def final(self) -> Column:
        if self.how == "mean":
            return F.try_divide(F.col(self.a).cast("double"), F.col(self.b).cast("double"))
        if self.how == "last" and len(self.order) > 1:
            return F.col(self.a)["v"]
        return F.col(self.a)


def _measures(df: DataFrame, columns: Sequence[str], stated: Mapping[str, str], order_by: Sequence[str]) -> list[_Measure]:
    measures = []
    for i, column in enumerate(columns):
        how = stated.get(column)
        if how is None:
            how = "sum" if isinstance(df.schema[column].dataType, T.NumericType) else "count"
        how = "mean" if how == "avg" else how
        if how not in AGGREGATES:
            raise ValueError(f"unknown aggregate {how!r} for {column!r}")
        if how == "last" and not order_by:
            raise ValueError(f"'last' of {column!r} needs order_by: a table has no arrival order")
        measures.append(_Measure(i, column, how, order_by))
    return measures


# --- the compiler -----------------------------------------------------------------------------


def same(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str) -> Column:
    """Equality of columns with their renamed partners that also matches null with null."""
    match = F.lit(True)
    for name in names:
        match = match & left[name].eqNullSafe(right[f"{prefix}{name}"])
    return match


def _levels(df: DataFrame, keys: Sequence[str], levels: str) -> DataFrame:
    """Each row once per level, with the keys below the level set to null."""
    n = len(keys)
    if levels == "leaf":
        return df.withColumn(LEVEL, F.lit(n))
    leveled = df.withColumn(LEVEL, F.explode(F.array(*[F.lit(i) for i in range(n + 1)])))
    return leveled.withColumns({k: F.when(F.col(LEVEL) > i, F.col(k)) for i, k in enumerate(keys)})


def split_values(df: DataFrame, split: str, limit: int = MAX_SPLITS) -> list:
    """The distinct values of a split column, sorted, at most ``limit`` of them on the driver.

    More is an error, not a cut: ``layout="rows"`` has a row per split value and no bound.
    """
    rows = df.select(q(split).alias("v")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} values of {split!r}; use layout='rows' or pass splits")
    found = [r["v"] for r in rows]
    return sorted(v for v in found if v is not None) + ([None] if None in found else [])


class ViewPlan:
    """A checked config for tables with the columns of ``df``: rows to parts, and parts to the view."""

    def __init__(self, df: DataFrame, config: Mapping, order_by: Sequence[str] = (), levels: str = "all", layout: str = "columns"):
        unknown = set(config) - DATA_KEYS - DISPLAY_KEYS
        if unknown:
            raise ValueError(f"unknown config keys: {sorted(unknown)}")
        if levels not in ("all", "leaf") or layout not in ("columns", "rows"):
            raise ValueError("levels is 'all' or 'leaf', layout is 'columns' or 'rows'")
        self.levels, self.layout, self.order_by = levels, layout, list(order_by)
        self.group_by = list(config.get("group_by") or [])
        self.split_by = list(config.get("split_by") or [])
        if len(self.split_by) > 1:
            raise ValueError("one split_by column is supported")
        self.expressions = config.get("expressions") or {}
        self.conditions = list(config.get("filter") or [])
        self.sort = [(c, d) for c, d in (config.get("sort") or [])]
        base = self.expressed(df)
        self.columns = [c for c in (config.get("columns") or base.columns) if c is not None]
        used = [*self.group_by, *self.split_by, *self.columns, *[c[0] for c in self.conditions], *self.order_by]
        missing = sorted({c for c in used if c not in base.columns})
        if missing:
            raise ValueError(f"columns not in the table: {missing}")
        for name, direction in self.sort:
            if direction not in ("asc", "desc"):
                raise ValueError(f"sort direction is 'asc' or 'desc': {direction!r}")
        self.keys = [f"__k{i}" for i in range(len(self.group_by))]
        self.split = ["__s"] if self.split_by else []
        self.group = [*self.keys, *self.split]
        self.measures = []
        if self.group:
            self.measures = _measures(base, self.columns, dict(config.get("aggregates") or {}), self.order_by)
        self.plain = [m for m in self.measures if m.how != "dominant"]
        self.dominant = {i: m.column for i, m in enumerate(self.measures) if m.how == "dominant"}
        self.late = [m for m in self.plain if m.how == "last" and self._needs_moments(base, m)]

    def _needs_moments(self, base: DataFrame, measure: _Measure) -> bool:
        fixed = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
        if not isinstance(base.schema[self.order_by[0]].dataType, fixed):
            return False  # its greatest value cannot be held in a hash aggregate either
        return len(self.order_by) > 1 or not isinstance(base.schema[measure.column].dataType, fixed)

    def expressed(self, df: DataFrame) -> DataFrame:
        if not self.expressions:
            return df
        return df.select("*", *[expression_column(df, e).alias(n) for n, e in self.expressions.items()])

    def base(self, df: DataFrame) -> DataFrame:
        """The rows that count, with the expressions."""
        rows = self.expressed(df)
        for condition in self.conditions:
            rows = rows.filter(filter_column(condition))
        return rows

    def prepared(self, base: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        """The group and split values under names of their own, and the columns that are aggregated."""
        needed = dict.fromkeys([*self.columns, *self.order_by, *extra])
        return base.select(
            *[q(c).alias(k) for c, k in zip(self.group_by, self.keys)], *[q(c).alias(s) for c, s in zip(self.split_by, self.split)],
            *[q(c) for c in needed],
        )

    def leaf(self, prepared: DataFrame) -> DataFrame:
        """Parts per group and split value: ``__rows`` and those of every aggregate but ``dominant``."""
        direct = [p for m in self.plain if m not in self.late for p in m.parts()]
        parts = prepared.groupBy(*self.group).agg(F.count(F.lit(1)).alias("__rows"), *direct)
        if not self.late:
            return parts
        moments = prepared.groupBy(*self.group).agg(*[m.moment() for m in self.late])
        side = small_side(moments.withColumnsRenamed({c: f"__m{c}" for c in self.group}))
        first = q(self.order_by[0])
        newest = F.lit(False)
        for m in self.late:
            newest = newest | (first == F.col(m.t))
        few = prepared.join(side, same(prepared, side, self.group, "__m") & newest)
        # A row may have one measure's moment and not another's.
        held = few.select(*self.group, *[q(c) for c in self.order_by], *[
            F.when(first == F.col(m.t), q(m.column)).alias(f"__v{m.a}") for m in self.late])
        picked = held.groupBy(*self.group).agg(*[p for m in self.late for p in m.renamed(f"__v{m.a}").parts()])
        picked = picked.withColumnsRenamed({c: f"__p{c}" for c in self.group})
        return parts.join(picked, same(parts, picked, self.group, "__p"), "left").drop(*[f"__p{c}" for c in self.group])

    def merged(self, parts: DataFrame, by: Sequence[str]) -> DataFrame:
        """Parts of equal groups made one."""
        return parts.groupBy(*by).agg(F.sum("__rows").alias("__rows"), *[p for m in self.plain for p in m.merged()])

    def counts(self, prepared: DataFrame, column: str) -> DataFrame:
        """(group, split, __v, __c): how often each value of a column occurs."""
        values = prepared.select(*self.group, q(column).alias("__v")).filter(F.col("__v").isNotNull())
        return values.groupBy(*self.group, "__v").agg(F.count(F.lit(1)).alias("__c"))

    def candidates(self, prepared: DataFrame, column: str, hashes: int = PRUNE_HASHES) -> DataFrame:
        """``counts`` without values that cannot be the most frequent one of any group of any level.

        Counts per hash of the value are kept, ``hashes`` of them per group, and what holds for hashes can be summed over
        levels. A value left in for one level may miss rows that another level has, but then it cannot win there.
        """
        values = prepared.select(*self.group, q(column).alias("__v")).filter(F.col("__v").isNotNull())
        values = values.withColumn("__h", F.pmod(F.xxhash64("__v"), F.lit(hashes)).cast("int"))
        own = [*self.group, "__h"]
        held = durable(values.groupBy(*own).agg(F.count(F.lit(1)).alias("__c")))
        by = [LEVEL, *self.group]
        leveled = _levels(held.withColumns({f"__o{c}": F.col(c) for c in own}), self.keys, self.levels)
        above = leveled.groupBy(*by, "__h").agg(F.sum("__c").alias("__n"))

        def counted(chosen: DataFrame) -> DataFrame:
            """Exact counts of the values whose hash is chosen at some level, at the finest grain."""
            side = chosen.withColumnsRenamed({c: f"__q{c}" for c in (*by, "__h")})
            mine = leveled.join(side, same(leveled, side, [*by, "__h"], "__q"), "left_semi")
            wanted = small_side(durable(mine.select(*[F.col(f"__o{c}").alias(f"__w{c}") for c in own]).distinct()))
            kept = values.join(wanted, same(values, wanted, own, "__w"), "left_semi")
            return kept.groupBy(*self.group, "__v").agg(F.count(F.lit(1)).alias("__c"))

        fullest = above.groupBy(*by).agg(F.max(F.struct("__n", "__h"))["__h"].alias("__h"))
        totals = _levels(counted(fullest), self.keys, self.levels).groupBy(*by, "__v").agg(F.sum("__c").alias("__c"))
        least = totals.groupBy(*by).agg(F.max("__c").alias("__least")).withColumnsRenamed({c: f"__l{c}" for c in by})
        reaching = above.join(least, same(above, least, by, "__l")).filter(F.col("__n") >= F.col("__least"))
        return counted(reaching.select(*by, "__h"))

    def best(self, counts: DataFrame, name: str) -> DataFrame:
        """The most frequent value per group of every level; of equally frequent ones the smallest."""
        by = [LEVEL, *self.group]
        counts = _levels(counts, self.keys, self.levels).groupBy(*by, "__v").agg(F.sum("__c").alias("__c"))
        best = F.min(F.struct((-F.col("__c")).alias("c"), F.col("__v").alias("v")))
        return counts.groupBy(*by).agg(best["v"].alias(name))

    def finish(self, leaf: DataFrame, counts: Mapping[int, DataFrame], splits: Sequence | None = None) -> DataFrame:
        """The view from its parts; ``splits`` lists the split values if they become columns."""
        by = [LEVEL, *self.group]
        grouped = self.merged(_levels(leaf, self.keys, self.levels), by)
        result = grouped.select(*by, *[m.final().alias(f"__m{i}") for i, m in enumerate(self.measures) if m in self.plain])
        for i in self.dominant:
            side = self.best(counts[i], f"__m{i}").withColumnsRenamed({c: f"__r{c}" for c in by})
            result = result.join(side, same(result, side, by, "__r"), "left").drop(*[f"__r{c}" for c in by])

        names = [LEVEL, *self.group_by]
        if self.split and self.layout == "columns":
            labels = _labels(splits)
            cells = []
            for v in splits:
                mine = F.col("__s").isNull() if v is None else F.col("__s") == F.lit(v)
                for i, m in enumerate(self.measures):
                    cell = F.max(F.when(mine, F.col(f"__m{i}")))
                    # A group without rows for a value counts 0 of them; its other cells are null.
                    cell = F.coalesce(cell, F.lit(0)) if m.how == "count" else cell
                    cells.append(cell.alias(f"{labels[v]}|{m.column}"))
            grouped = result.groupBy(LEVEL, *self.keys)
            result = grouped.agg(*cells) if cells else result.select(LEVEL, *self.keys).distinct()
            shown = [f"{labels[v]}|{m.column}" for v in splits for m in self.measures]
            result = result.select(LEVEL, *self.keys, *[q(c) for c in shown])
        else:
            names = [*names, *self.split_by]
            shown: list[str] = []
            others = {m.column for m in self.measures if m.column not in names}
            for m in self.measures:
                shown.append(_free_name(m.column, m.how, [*names, *shown, *(others if m.column in names else ())]))
            result = result.select(*by, *[F.col(f"__m{i}").alias(s) for i, s in enumerate(shown)])
        result = result.toDF(*names, *shown)
        if not self.sort:
            return result
        apart = self.split and self.layout == "columns"
        by_source = {} if apart else {m.column: s for m, s in zip(self.measures, shown)}
        resolved = [(by_source.get(n, n), d) for n, d in self.sort]
        bad = [n for n, _ in resolved if n not in result.columns]
        if bad:
            raise ValueError(f"cannot sort by {bad}")
        return result.orderBy(F.col(LEVEL), *_sort_columns(resolved))


def _many_values(prepared: DataFrame, group: Sequence[str], column: str) -> bool:
    """Whether the values per group are more than ``PRUNE_FROM``; one pass over few columns if the rows are as many."""
    if prepared.limit(PRUNE_FROM + 1).count() <= PRUNE_FROM:
        return False
    number = F.approx_count_distinct(F.xxhash64(*group, q(column)))
    return prepared.agg(number.alias("n")).first()["n"] > PRUNE_FROM


def view(
    df: DataFrame,
    config: Mapping,
    order_by: Sequence[str] = (),
    levels: str = "all",
    splits: Sequence | None = None,
    layout: str = "columns",
    max_splits: int = MAX_SPLITS,
) -> DataFrame:
    """Compile a view config.

    ``order_by`` defines what ``last`` means; it should be unique, and one column is faster than several.
    ``levels="leaf"`` leaves out totals and subtotals.
    ``splits`` lists the split values and saves the job that finds them; more than ``max_splits`` are an
    error. ``layout="rows"`` returns one row per group and split value in place of a column per value.
    """
    plan = ViewPlan(df, config, order_by, levels, layout)
    base = plan.base(df)
    if not plan.group:
        extra = [name for name, _ in plan.sort if name not in plan.columns]
        if any(e not in base.columns for e in extra):
            raise ValueError(f"cannot sort by {extra}")
        if plan.sort:
            base = base.orderBy(*_sort_columns(plan.sort))
        return base.select(*[q(c) for c in plan.columns])
    prepared = plan.prepared(base)
    counts = {
        i: plan.candidates(prepared, c) if _many_values(prepared, plan.group, c) else plan.counts(prepared, c)
        for i, c in plan.dominant.items()
    }
    if plan.split and layout == "columns" and splits is None:
        splits = split_values(base, plan.split_by[0], max_splits)
    return plan.finish(plan.leaf(prepared), counts, splits)


def _sort_columns(sort: Sequence[tuple[str, str]]) -> list[Column]:
    return [q(n).asc_nulls_last() if d == "asc" else q(n).desc_nulls_last() for n, d in sort]


def _labels(values: Sequence) -> dict:
    """Split values as text; a real null beside a text "null" gets underscores."""
    labels = {v: str(v) for v in values if v is not None}
    null = "null"
    while null in labels.values():
        null += "_"
    return {**labels, None: null}


def _free_name(column: str, how: str, taken: Sequence[str]) -> str:
    """A grouped column shown as a measure too is told apart by its aggregate, and by underscores if that is taken."""
    name = f"{column}_{how}" if column in taken else column
    while name in taken:
        name += "_"
    return name
