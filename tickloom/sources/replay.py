"""A stored table played back in frames of a fixed number of rows."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.spans import fixed_micros, instant
from tickloom.operators.ordering import Order, positions
from tickloom.session import list_dir

FRAME = "frame"


def replay_table(
    df: DataFrame,
    order: Sequence[Order],
    chunk: int,
    start_time: str,
    interval: str,
    loops: int = 1,
    end_time: str | None = None,
    ts: str = "replay_ts",
) -> DataFrame:
    """Number the rows along a unique order and give each its frame and the time of that frame.

    ``chunk`` rows make a frame, frames are ``interval`` apart from ``start_time`` on, and the whole
    table comes ``loops`` times in a row. Nothing at or after ``end_time`` is kept.
    """
    if chunk < 1 or loops < 1:
        raise ValueError("chunk and loops are at least 1")
    numbered = positions(df, order, "__position")
    if loops > 1:
        # The loop borders need the row count; Spark plans it as a scalar subquery.
        total = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
        numbered = numbered.withColumn("__loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
        numbered = numbered.withColumn("__position", F.col("__position") + F.col("__loop") * total).drop("__loop")
    frame = F.call_function("div", F.col("__position"), F.lit(chunk).cast("bigint"))
    step = F.lit(fixed_micros(interval)).cast("bigint")
    clock = F.timestamp_micros(F.unix_micros(instant(start_time, "timestamp")) + frame * step)
    framed = numbered.select(*df.columns, frame.alias(FRAME), clock.alias(ts))
    return framed if end_time is None else stop_at(framed, ts, end_time)


def stop_at(df: DataFrame, ts: str, end_time: str) -> DataFrame:
    """No rows at or after ``end_time``."""
    return df.filter(F.col(ts) < instant(end_time, df.schema[ts].dataType.simpleString()))


def write_frames(framed: DataFrame, path: str, order: Sequence[str]) -> None:
    """Store framed rows with one folder per frame; choose frames large enough for a file each."""
    ranged = framed.repartitionByRange(FRAME, *order).sortWithinPartitions(FRAME, *order)
    ranged.write.mode("overwrite").partitionBy(FRAME).parquet(path)


def frame_numbers(spark: SparkSession, path: str) -> list[int]:
    """The stored frames, in order; one number per folder."""
    prefix = f"{FRAME}="
    return sorted(int(n[len(prefix):]) for n in list_dir(spark, path) if n.startswith(prefix))


def play_frames(
    spark: SparkSession, path: str, target: str, order: Sequence[str], period_seconds: float = 0.0,
    frames: Sequence[int] | None = None, files: int = 1,
) -> int:
    """Publish frame after frame into the folder ``target``, which a file stream watches.

    Each frame is read from its own folder only and appended as ``files`` files, more than one for
    large frames. Files get newer in frame order, so a stream with ``maxFilesPerTrigger`` of that number
    sees one frame per batch. The loop is the pacing: it starts one job per period.
    """
    numbers = frame_numbers(spark, path) if frames is None else list(frames)
    schema = spark.read.parquet(path).schema
    for number in numbers:
        begin = time.monotonic()
        rows = spark.read.schema(schema).parquet(path).filter(F.col(FRAME) == number)
        spread = rows.coalesce(1) if files == 1 else rows.repartition(files)
        spread.sortWithinPartitions(*order).write.mode("append").parquet(target)
        time.sleep(max(0.0, period_seconds - (time.monotonic() - begin)))
    return len(numbers)


def file_replay_source(spark: SparkSession, target: str, schema, files_per_batch: int = 1) -> DataFrame:
    """The published frames as a stream, oldest first."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("latestFirst", "false").parquet(target)
