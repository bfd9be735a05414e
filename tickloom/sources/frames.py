"""Stored frames as a stream of Spark's own making: offsets are frame numbers, and a file of a frame is a partition.

Nothing is copied into a watched folder and no loop starts a job per frame. A query that starts again goes on after the
last frame of its checkpoint. The code runs in Spark's Python workers, which need not have this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "tickloom_frames"


@dataclass
class FrameFile(InputPartition):
    path: str
    frame: int


class FrameReader(DataSourceStreamReader):
    """Offsets name the last frame that is played; -1 is before the first."""

    def __init__(self, path: str, column: str, per_batch: int, schema: T.StructType) -> None:
        self.path, self.column, self.per_batch = path, column, per_batch
        self.schema = to_arrow_schema(schema)
        self.at: int | None = None
        self.frames: list[int] = []

    def _listed(self) -> list[int]:
        files, root = pafs.FileSystem.from_uri(self.path)
        prefix = f"{self.column}="
        found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name[len(prefix):]) for f in found if f.base_name.startswith(prefix))

    def initialOffset(self) -> dict:
        return {"frame": -1}

    def latestOffset(self) -> dict:
        """``per_batch`` frames on from the last one handed out, as far as there are any; 0 means all."""
        at = -1 if self.at is None else self.at
        if not self.frames or at >= self.frames[-1]:
            self.frames = self._listed()
        ahead = [f for f in self.frames if f > at]
        if ahead:
            at = ahead[min(self.per_batch or len(ahead), len(ahead)) - 1]
        self.at = at
        return {"frame": at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # A query that starts again asks for its last planned batch first, whose end is where it goes on.
        self.at = max(end["frame"], -1 if self.at is None else self.at)
        files, root = pafs.FileSystem.from_uri(self.path)
        found = []
        for frame in self._listed():
            if start["frame"] < frame <= end["frame"]:
                selector = pafs.FileSelector(f"{root}/{self.column}={frame}")
                found += [FrameFile(f.path, frame) for f in files.get_file_info(selector) if f.base_name.endswith(".parquet")]
        return found

    def read(self, partition: FrameFile) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(self.path)
        wanted = [n for n in self.schema.names if n != self.column]
        with files.open_input_file(partition.path) as handle:
            for batch in pq.ParquetFile(handle).iter_batches(columns=wanted):
                made = {n: batch.column(n) for n in wanted}
                made[self.column] = pa.array([partition.frame] * batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in self.schema], schema=self.schema)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: T.StructType) -> FrameReader:
        return FrameReader(self.options["path"], self.options["column"], int(self.options["per_batch"]), schema)


def frame_stream(
    spark: SparkSession, path: str, per_batch: int = 1, column: str = "frame", schema: T.StructType | None = None
) -> DataFrame:
    """The frames that :func:`tickloom.sources.replay.write_frames` stored below ``path`` as a stream, in their order.

    A batch is ``per_batch`` frames, and the trigger of the query is the pacing; 0 makes one batch of all there are.
    Frames stored later are played too if their numbers are higher. ``path`` must be one that pyarrow reads. A query
    that reads to the end and stops (``availableNow``) plays one batch a run; ``processAllAvailable`` plays all. Without
    a ``schema`` there has to be a frame to take it from.
    """
    if per_batch < 0:
        raise ValueError("per_batch is at least 0")
    spark.dataSource.register(FrameSource)
    stored = schema or spark.read.parquet(path).schema
    schema = T.StructType([f for f in stored.fields if f.name != column] + [T.StructField(column, T.LongType())])
    reader = spark.readStream.format(NAME).schema(schema)
    return reader.option("path", path).option("column", column).option("per_batch", per_batch).load()
