"""Micro-batches, live tables that keep the newest rows, and views over them."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.spans import column_type, fixed_micros, instant, latest, span_interval
from tickloom.operators.filters import Moment, range_filter
from tickloom.operators.ordering import Order, sort_multi
from tickloom.operators.tables import anti_new_keys
from tickloom.plans.view import view
from tickloom.session import delete_dir, get_line, list_dir, put_line
from tickloom.sources.files import write_by_key

PERIOD = "250 milliseconds"
Sink = Callable[[DataFrame, int], None]


# --- micro-batches and their sinks --------------------------------------------------------------


def micro_batch(
    stream: DataFrame, sink: Sink, checkpoint: str, period: str | None = PERIOD, output_mode: str = "append"
) -> StreamingQuery:
    """Hand every micro-batch to ``sink(batch, batch_id)``; without a period, read what is there and stop."""
    writer = stream.writeStream.foreachBatch(sink).outputMode(output_mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)
    return writer.start()


def fan_out(stream: DataFrame, sinks: Sequence[Sink], checkpoint: str, period: str | None = PERIOD) -> StreamingQuery:
    """Every micro-batch goes to all sinks, computed once. After a failure a batch may come again with
    the same id, so sinks must write by id, as :func:`parquet_sink` does."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, batch_id)
        finally:
            held.unpersist()

    return micro_batch(stream, deliver, checkpoint, period)


def parquet_sink(path: str) -> Sink:
    """A sink that stores each batch in a folder named by its id; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def day_sink(path: str, ts: str, day: str = "day") -> Sink:
    """A sink as :func:`parquet_sink`, with a folder per day of ``ts`` in each batch's folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn(day, F.to_date(ts))
        dated.write.mode("overwrite").partitionBy(day).parquet(f"{path}/batch_id={batch_id}")

    return write


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """What a :func:`day_sink` stored, with ``batch_id`` and the day as folder columns."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")


# --- the live table -------------------------------------------------------------------------------


def snapshot_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions written to the end, oldest first."""
    found = [int(n.split("=", 1)[1]) for n in list_dir(spark, path) if n.startswith("version=")]
    return sorted(v for v in found if "_SUCCESS" in list_dir(spark, f"{path}/version={v}"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a live table."""
    versions = snapshot_versions(spark, path)
    if not versions:
        raise ValueError(f"no snapshot in {path}")
    return spark.read.parquet(f"{path}/version={versions[-1]}")


def write_version(rows: DataFrame, path: str, version: int, keep: int = 3) -> None:
    """Write a version, replacing one of the same number, and delete all but the last ``keep``."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")
    older = [v for v in snapshot_versions(spark, path) if v < version]
    for old in older[: max(0, len(older) - keep + 1)]:
        delete_dir(spark, f"{path}/version={old}")


def update_snapshot(
    batch: DataFrame, batch_id: int, path: str, order: Sequence[Order], limit: int, keep: int = 3
) -> None:
    """Merge a batch into a live table that holds the newest ``limit`` rows, the first ones by ``order``.

    The result becomes version ``batch_id``, so a repeated batch replaces its own version. Only the
    last ``keep`` versions stay.
    """
    spark = batch.sparkSession
    versions = [v for v in snapshot_versions(spark, path) if v < batch_id]
    rows = batch
    if versions:
        rows = spark.read.schema(batch.schema).parquet(f"{path}/version={versions[-1]}").unionByName(batch)
    write_version(sort_multi(rows, order).limit(limit), path, batch_id, keep)


def bounded_table(path: str, order: Sequence[Order], limit: int) -> Sink:
    """A sink that keeps the newest rows of a stream."""
    return lambda batch, batch_id: update_snapshot(batch, batch_id, path, order, limit)


def live_view(
    table_path: str, view_path: str, config: Mapping, order: Sequence[Order], limit: int,
    order_by: Sequence[str] = (), **options,
) -> Sink:
    """A sink that keeps the newest rows and recomputes a view over them on every batch."""

    def refresh(batch: DataFrame, batch_id: int) -> None:
        update_snapshot(batch, batch_id, table_path, order, limit)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{table_path}/version={batch_id}")
        write_version(view(rows, config, order_by, **options), view_path, batch_id)

    return refresh


def rolling_view(
    table: DataFrame, ts: str, span: str, config: Mapping, order_by: Sequence[str] = (), as_of: Moment = None,
    day: str | None = None, **options,
) -> DataFrame:
    """A view over the last ``span`` before ``as_of``, by default the newest row's time.

    ``day`` names a folder column that holds the date of ``ts``: then older days are not read at all.
    """
    back = f"-{span.lstrip('-')}"
    moment = as_of
    if moment is None:
        newest = table if day is None else table.filter(F.col(day) == F.lit(table.agg(F.max(day)).first()[0]))
        moment = latest(newest, ts)
    rows = range_filter(table, ts, back, as_of=moment)
    if day is not None:
        first = (instant(moment, column_type(table, ts)) + span_interval(back)).cast("date")
        rows = rows.filter(F.col(day) >= first)
    return view(rows, config, order_by, **options)


# --- event time -------------------------------------------------------------------------------


def dedupe_overlap(path: str, ts: str, keys: Sequence[str], delay: str = "10 seconds", day: str = "day") -> Sink:
    """A sink that stores each key once, although overlapping polls deliver it several times.

    Nothing is too late: a key that is not stored yet is stored however far back its row lies. The rows lie in folders
    as of :func:`day_sink`, and of them only the keys of the days within ``delay`` of a batch's rows are read, so the
    times of rows with one key may differ by ``delay``. Null keys count as equal. A repeated batch replaces itself.
    """
    write = day_sink(path, ts, day)
    back = span_interval(f"-{delay}")

    def once(batch: DataFrame, batch_id: int) -> None:
        spark, held = batch.sparkSession, batch.dropDuplicates(list(keys)).persist()
        try:
            fresh = held
            if any(n.startswith("batch_id=") and int(n.split("=", 1)[1]) < batch_id for n in list_dir(spark, path)):
                near = F.sequence(F.to_date(F.col(ts) + back), F.to_date(F.col(ts) - back))
                days = [r[0] for r in held.select(F.explode_outer(near)).distinct().collect()]
                dated = T.StructType([*batch.schema, T.StructField(day, T.DateType()), T.StructField("batch_id", T.LongType())])
                stored = spark.read.schema(dated).option("basePath", path).parquet(f"{path}/batch_id=*")
                touched = F.col(day).isin([d for d in days if d is not None]) | (F.col(day).isNull() & F.lit(None in days))
                known = stored.filter((F.col("batch_id") < batch_id) & touched).select(*[F.col(k).alias(f"__{k}") for k in keys])
                same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
                fresh = held.join(known, same, "left_anti")
            write(fresh, batch_id)
        finally:
            held.unpersist()

    return once


def event_time_windows(
    stream: DataFrame,
    ts: str,
    width: str,
    series: Sequence[str],
    aggregates: Mapping[str, Column],
    delay: str = "10 seconds",
    slide: str | None = None,
) -> DataFrame:
    """Aggregates per window of event time; rows later than ``delay`` behind the newest are dropped.

    In append mode a window comes out once, when the newest row is ``delay`` past its end, and its state goes with it.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    rows = timed.groupBy(window, *series).agg(*[a.alias(n) for n, a in aggregates.items()])
    names = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return rows.select(*names, *series, *aggregates)


# --- retention and loading ----------------------------------------------------------------------


def expire_old(df: DataFrame, ts: str, age: str = "365d", as_of: Moment = None) -> DataFrame:
    """Rows at most ``age`` older than ``as_of``, by default the newest row's time."""
    moment = latest(df, ts) if as_of is None else as_of
    return range_filter(df, ts, f"-{age.lstrip('-')}", as_of=moment)


def drop_old_days(spark: SparkSession, path: str, first_day: str, day: str = "day") -> list[str]:
    """Delete the day folders before ``first_day`` (yyyy-MM-dd) of a table partitioned by day."""
    prefix = f"{day}="
    old = [n for n in list_dir(spark, path) if n.startswith(prefix) and n[len(prefix):] < first_day]
    for name in old:
        delete_dir(spark, f"{path}/{name}")
    return old


def incremental_append(incoming: DataFrame, path: str, key: str, order: Sequence[str]) -> DataFrame:
    """Add the keys a store does not have yet and return the store.

    A load writes its new keys into a folder of its own, one folder per key with rows in ``order``. Only then a list of
    the loads that count is renamed into place, in one step. Readers follow the newest list (``read_loads``), so a load that
    breaks off, even between two files, is never seen, and repeating it starts afresh. Known keys are values of a folder
    column, for which no stored row is decoded, and nothing stored is rewritten. One load at a time.
    """
    spark = incoming.sparkSession
    version, loads = listed_loads(spark, path)
    fresh = incoming
    if loads:
        fresh = anti_new_keys(incoming, read_loads(spark, path, incoming.schema), key)
    number = version + 1
    # What a broken load of this number left is replaced.
    write_by_key(fresh, f"{path}/load={number}", key, order)
    put_line(spark, f"{path}/lists/{number:09d}.json", json.dumps([*loads, number]))
    return read_loads(spark, path, incoming.schema).select(incoming.columns)


def listed_loads(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The number of the newest list of a store, and the loads on it; -1 and none at the start."""
    lists = [n for n in list_dir(spark, f"{path}/lists") if n.endswith(".json") and n[0].isdigit()]
    if not lists:
        return -1, []
    return int(lists[-1].split(".")[0]), json.loads(get_line(spark, f"{path}/lists/{lists[-1]}"))


def read_loads(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all loads that are on the newest list."""
    _, loads = listed_loads(spark, path)
    found = [spark.read.schema(schema).parquet(f"{path}/load={n}") for n in loads]
    if not found:
        return spark.createDataFrame([], schema)
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def merge_loads(spark: SparkSession, path: str, schema: T.StructType, key: str, order: Sequence[str]) -> None:
    """Write all listed loads as one and list that alone, for a store of many small loads; older folders stay for their readers."""
    version, loads = listed_loads(spark, path)
    if len(loads) > 1:
        write_by_key(read_loads(spark, path, schema), f"{path}/load={version + 1}", key, order)
        put_line(spark, f"{path}/lists/{version + 1:09d}.json", json.dumps([version + 1]))


# --- windows that show what came too late ------------------------------------------------------------

MERGES = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def windows_and_late_rows(
    path: str, late_path: str, ts: str, width: str, series: Sequence[str], aggregates: Mapping[str, tuple[str, str]],
    delay: str = "10 seconds",
) -> Sink:
    """A sink of tumbling windows that loses no row without trace.

    ``aggregates`` maps names to (count, sum, min or max; column). Closed windows go to ``path``, in a folder per batch, once
    the newest time seen is ``delay`` past their end. A row whose window has been closed by an earlier batch goes to ``late_path``
    instead, with its ``lateness``, the time by which it missed the closing, so rows in windows and late rows together are the input.
    Rows without a time are late rows without a lateness. Open windows are stored as mergeable parts, by batch, and a batch that is
    repeated starts from the version before it. Windows that are still open are read with ``open_windows``.
    """
    span = int(fixed_micros(width))
    names = [*series, "window_start"]
    state_path = f"{path}-open"

    def deliver(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = [v for v in snapshot_versions(spark, state_path) if v < batch_id]
        closed = int(get_line(spark, f"{state_path}/closed-{versions[-1]}.txt")) if versions else -(1 << 62)
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        start = micros - F.pmod(micros, F.lit(span))
        rows = batch.withColumns({"__end": start + span, "window_start": F.timestamp_micros(start)}).persist()
        try:
            missed = F.col("__end").isNull() | (F.col("__end") <= closed)
            gap = F.make_dt_interval(secs=((F.lit(closed) - micros) / 1e6).cast("decimal(18,6)"))
            late = rows.filter(missed).select(*batch.columns, gap.alias("lateness"))
            late.write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
            kinds = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
            parts = rows.filter(~missed).groupBy(*names).agg(
                F.max("__end").alias("__end"), *[kinds[how](c).alias(n) for n, (how, c) in aggregates.items()])
            if versions:
                fresh = parts.schema
                parts = spark.read.schema(fresh).parquet(f"{state_path}/version={versions[-1]}").unionByName(parts)
                # A sum of decimal sums would be wider after every batch.
                merged = [MERGES[how](n).cast(fresh[n].dataType).alias(n) for n, (how, _) in aggregates.items()]
                parts = parts.groupBy(*names).agg(F.max("__end").alias("__end"), *merged)
            newest = rows.agg(F.max(micros).alias("m")).first()["m"]
            bound = closed if newest is None else max(closed, newest - fixed_micros(delay))
            parts = parts.persist()
            done = parts.filter(F.col("__end") <= bound).withColumn("window_end", F.timestamp_micros("__end"))
            done.select("window_start", "window_end", *series, *aggregates).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            put_line(spark, f"{state_path}/closed-{batch_id}.txt", str(bound))
            write_version(parts.filter(F.col("__end") > bound), state_path, batch_id)
            parts.unpersist()
        finally:
            rows.unpersist()

    return deliver


def open_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows of :func:`windows_and_late_rows` that are not closed yet."""
    return read_snapshot(spark, f"{path}-open").drop("__end")
