"""Outage masking on a stream, in two forms.

``mask_outages_stream`` is a stateful streaming operator: the countdown of a station is a value state that exists only
while an outage is open, and a timer takes it away when the station has been silent for ``idle``. All rows of a station in a
micro-batch meet in one task, in pandas.

``outage_sink`` is for stations of any size: a micro-batch is masked by the batch operator, in column functions and over slices
of a station, and the countdowns are a small table with a version per batch.
"""

from __future__ import annotations

import sys
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.spans import fixed_micros
from tickloom.operators.outages import AT, FREE, in_outage, masked_columns, outage_rows
from tickloom.operators.series import ROWS_PER_SLICE
from tickloom.streaming.live import Sink, snapshot_versions, write_version

# What runs in Python workers travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_countdown(durations: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(masked, fault, countdown left) for rows in order; a duration above 0 is a trigger.

    The trigger row is a fault but keeps its values, the ``duration`` rows after it are masked, and the
    last of those is no longer a fault. Triggers inside an outage count for nothing.
    """
    n = len(durations)
    masked = np.zeros(n, dtype=bool)
    fault = np.zeros(n, dtype=bool)
    masked[:start] = True
    fault[: max(0, start - 1)] = True
    free, left = start, max(0, start - n)
    for at in np.flatnonzero(durations > 0):
        if at < free:
            continue
        length = int(durations[at])
        masked[at + 1 : at + 1 + length] = True
        fault[at : at + length] = True
        free = at + 1 + length
        left = max(0, free - n)
    return masked, fault, left


class Countdown(StatefulProcessor):
    """The open outage of each station: how many rows it still masks, and when the station was last heard of."""

    def __init__(self, order: Sequence[str], trigger: str, readings: Sequence[str], status: str, ts: str | None, idle_ms: int):
        self.order, self.trigger, self.readings, self.status = list(order), trigger, list(readings), status
        self.ts, self.idle_ms = ts, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "rows BIGINT, seen BIGINT")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # Joining frames warns about all-null columns.
        warnings.simplefilter("ignore", FutureWarning)
        frame = pd.concat(list(rows)).sort_values(self.order)
        start, seen = self.open.get() if self.open.exists() else (0, 0)
        durations = frame[self.trigger].fillna(0).to_numpy(dtype=np.int64)
        masked, fault, left = run_countdown(durations, start)
        if left:
            if self.ts is not None:
                seen = max(seen, int(frame[self.ts].max().timestamp() * 1000))
                self.handle.registerTimer(seen + self.idle_ms)
            self.open.update((left, seen))
        elif start:
            self.open.clear()
        for name in self.readings:
            frame[name] = np.where(masked, 0, frame[name].to_numpy())
        frame[self.status] = np.where(fault, "fault", "normal")
        yield frame

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        # Timers of earlier batches go off too; only that of the last row heard of counts.
        if self.open.exists() and self.open.get()[1] + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def mask_outages_stream(
    stream: DataFrame, station: str, order: Sequence[str], trigger: str, readings: Sequence[str], status: str = "status",
    ts: str | None = None, idle: str = "1d", delay: str = "10 seconds",
) -> DataFrame:
    """Like ``mask_outages`` with the countdown of each station kept as state between micro-batches.

    Rows are ordered within a micro-batch; batches count in the order they arrive. One batch's rows of a
    station meet in one task, so the size of a batch (``maxFilesPerTrigger``) bounds that task. With an event time ``ts`` a
    timer ends the outage of a station that sends nothing for ``idle``, and rows more than ``delay`` behind the newest of
    all are dropped, as timers need a watermark. Needs the RocksDB state store, which is set for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = T.StructType([*stream.schema.fields, T.StructField(status, T.StringType())])
    processor = Countdown(order, trigger, readings, status, ts, fixed_micros(idle) // 1000)
    timed = stream if ts is None else stream.withWatermark(ts, delay)
    return timed.groupBy(station).transformWithStateInPandas(processor, schema, "append", "None" if ts is None else "EventTime")


def outage_sink(
    path: str, state_path: str, station: str, order: Sequence[str], trigger: str, readings: Sequence[str], status: str = "status",
    idle_batches: int = 1000, rows_per_slice: int = ROWS_PER_SLICE,
) -> Sink:
    """A sink that masks every micro-batch and stores it in ``path`` in a folder named by its id.

    Version B of the state holds (station, left, seen) of the stations with an open outage after batch B; one that sends
    nothing for ``idle_batches`` batches is forgotten. A repeated batch starts from the version before and replaces itself.
    """

    def mask(batch: DataFrame, batch_id: int) -> None:
        start = open_outages(batch.sparkSession, state_path, batch_id)
        rows = outage_rows(batch, station, order, trigger, rows_per_slice, start).persist()
        try:
            _, fault = in_outage()
            out = rows.select(*masked_columns(batch, readings), F.when(fault, "fault").otherwise("normal").alias(status))
            out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            ends = rows.groupBy(station).agg((F.max(f"__outage.{FREE}") - 1 - F.max(AT)).alias("left"))
            now = ends.filter("left > 0").select(station, "left", F.lit(batch_id).cast("bigint").alias("seen"))
            if start is not None:
                heard = ends.select(F.col(station).alias("__heard"))
                silent = start.join(heard, start[station].eqNullSafe(heard["__heard"]), "left_anti")
                now = now.unionByName(silent.filter(F.col("seen") > batch_id - idle_batches))
            write_version(now.coalesce(8), state_path, batch_id)
        finally:
            rows.unpersist()

    return mask


def open_outages(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame | None:
    """The newest state, or the newest one before a batch."""
    versions = [v for v in snapshot_versions(spark, state_path) if before is None or v < before]
    return spark.read.parquet(f"{state_path}/version={versions[-1]}") if versions else None
