"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFunction
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a function under its own name."""

    def register(function: QueryFunction) -> QueryFunction:
        if function.__name__ in REGISTRY:
            raise ValueError(f"two queries named {function.__name__}")
        REGISTRY[function.__name__] = Query(function, sql)
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def money(name: str) -> F.col:
    """A price column as a decimal, whose sums do not depend on the order of rows."""
    return F.col(name).cast("decimal(18,2)")


def view_sql(base: str, keys: list[str], measures: dict[str, str], splits: list[str] | None = None,
             split: str | None = None, levels: list[int] | None = None) -> str:
    """The SQL of a view: one SELECT per level, one FILTER per split value.

    A measure is SQL with ``{f}`` where a FILTER clause goes and ``{c}`` for the condition in it.
    """
    parts = []
    for level in levels if levels is not None else range(len(keys) + 1):
        shown = [f"{level} AS __level"]
        shown += [k if i < level else f"NULL AS {k}" for i, k in enumerate(keys)]
        for s in splits or [None]:
            condition = "TRUE" if s is None else f"{split} = '{s}'"
            for name, text in measures.items():
                label = name if s is None else f"{s}|{name}"
                shown.append(f'{text.replace("{f}", f"FILTER (WHERE {condition})").replace("{c}", condition)} AS "{label}"')
        grouped = f" GROUP BY {', '.join(keys[:level])}" if level else ""
        parts.append(f"SELECT {', '.join(shown)} FROM base{grouped}")
    return f"WITH base AS ({base}) " + " UNION ALL ".join(parts)


def mean_sql(c: str) -> str:
    return f"(sum({c}) {{f}})::DOUBLE / count({c}) {{f}}"


def last_sql(c: str, order: str) -> str:
    return f"arg_max({c}, {order}) FILTER (WHERE {{c}} AND {c} IS NOT NULL)"


def dominant_sql(c: str) -> str:
    counted = f"map_entries(histogram({c}) FILTER (WHERE {{c}} AND {c} IS NOT NULL))"
    return f"list_sort(list_transform({counted}, lambda e: {{'n': -(e.value::BIGINT), 'v': e.key}}))[1].v"
