"""Column layout, lookups, appending and typing of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import iso_string, null_non_finite


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)


def insert_column(df: DataFrame, position: int, name: str, value: Column | object) -> DataFrame:
    """A new column at a position."""
    value = value if isinstance(value, Column) else F.lit(value)
    columns = [F.col(c) for c in df.columns]
    columns.insert(position, value.alias(name))
    return df.select(*columns)


BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def small_side(dim: DataFrame) -> DataFrame:
    """``dim`` marked for broadcast if it is measured to be small, else as it is.

    Runs a job over at most ``BROADCAST_ROWS`` + 1 rows of it. Spark's own estimate is of no use here:
    it takes a table made from a list, or by an aggregate, for a huge one.
    """
    text = F.to_json(F.struct(*dim.columns))
    rows = dim.limit(BROADCAST_ROWS + 1).select(F.octet_length(text).alias("size"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    small = found["n"] <= BROADCAST_ROWS and found["size"] <= BROADCAST_BYTES
    return F.broadcast(dim) if small else dim


def lookup_join(df: DataFrame, dim: DataFrame, on: str, defaults: Mapping[str, Column | object]) -> DataFrame:
    """Left lookup of columns in a table by key, with a default where there is no match or a null.

    Rows never multiply: of several rows for a key the smallest counts, compared column by column.
    A table measured to be small is broadcast, so the rows stay where they are however few keys they
    have. A larger one is joined by key, with Spark splitting skewed partitions at run time.
    """
    row = F.min(F.struct(*[F.col(c).alias(f"__found_{c}") for c in defaults])).alias("__row")
    side = small_side(dim.groupBy(F.col(on).alias("__lookup")).agg(row).select("__lookup", "__row.*"))
    joined = df.join(side, df[on] == side["__lookup"], "left")
    kept = [c for c in df.columns if c not in defaults]
    found = [
        F.coalesce(F.col(f"__found_{c}"), d if isinstance(d, Column) else F.lit(d)).alias(c)
        for c, d in defaults.items()
    ]
    return joined.select(*kept, *found)


def execution_costs(
    df: DataFrame,
    trader_rates: DataFrame,
    venue_rates: DataFrame,
    qty: str = "qty",
    price: str = "price",
    trader: str = "trader",
    venue: str = "exec_venue",
    default_commission: float = 0.001,
    default_fee: float = 0.0005,
    digits: int | None = 4,
) -> DataFrame:
    """Add trade_value, commission and venue_fee; the rate tables have the key column and ``rate``.

    The fees are rounded to ``digits``, or not at all without.
    """
    first = lookup_join(df, trader_rates.withColumnRenamed("rate", "__commission"), trader,
                        {"__commission": default_commission})
    both = lookup_join(first, venue_rates.withColumnRenamed("rate", "__fee"), venue, {"__fee": default_fee})
    value = F.col(qty) * F.col(price)
    fees = {"commission": value * F.col("__commission"), "venue_fee": value * F.col("__fee")}
    return both.select(
        *df.columns,
        value.alias("trade_value"),
        *[(fee if digits is None else F.round(fee, digits)).alias(name) for name, fee in fees.items()],
    )


def anti_new_keys(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not stored yet; null counts as a key."""
    known = existing.select(F.col(key).alias("__known")).distinct()
    return incoming.join(known, incoming[key].eqNullSafe(known["__known"]), "left_anti")


def union_tables(tables: Sequence[DataFrame], schema: T.StructType | None = None,
                 spark: SparkSession | None = None) -> DataFrame:
    """All rows of several tables, matched by column name; a missing column is null."""
    if not tables:
        if schema is None or spark is None:
            raise ValueError("an empty list needs a schema and a session")
        return spark.createDataFrame([], schema)
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in the declared order and type; a column that is missing is an error."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def json_ready(df: DataFrame) -> DataFrame:
    """Values as JSON viewers read them: ISO text for timestamps, doubles for long integers, no NaN or infinity."""
    columns = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_string(c)
        elif isinstance(field.dataType, (T.LongType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            c = null_non_finite(c)
        columns.append(c.alias(field.name))
    return df.select(*columns)
