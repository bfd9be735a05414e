"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import scratch_path

# Texts are packed, or cut, into pieces of about this size before numpy sees them: arrays made from one stay in the
# processor's cache, and a text of any length takes little memory.
PIECE_BYTES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def ship(name: str) -> None:
    """Send the functions of module ``name`` to workers with each job, which need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in the Python worker process so that later tasks find warm caches.

    A worker keeps one such thing: the caches of one operator go before another's are made.
    """
    store = sys.modules.setdefault("_tickloom_worker", types.ModuleType("_tickloom_worker")).__dict__
    if store.get("key") != key:
        store.pop("kept", None)
        gc.unfreeze()
        gc.collect()
        store.update(key=key, kept=make())
    return store["kept"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, whatever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def unit_hash(*columns: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    shifted = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in columns]), 11)
    return shifted.cast("double") / F.lit(float(1 << 53))


def add_columns(
    df: DataFrame, text: str, fields: Sequence[tuple[str, T.DataType]], compute: Callable[[pa.Array], list[pa.Array]]
) -> DataFrame:
    """``df`` with columns that ``compute`` makes from the whole texts of a batch; null texts arrive as empty ones.

    Rows stay where they are: no shuffle, one Arrow batch at a time. Names in ``fields`` must be free in ``df``.
    """
    place = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])
    names = [f"c{i}" for i in range(len(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, place):
                made = compute(pc.fill_null(part.column(place), ""))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    plain = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, schema)])
    return df.mapInArrow(run, plain).toDF(*schema.names)


def sliced(batch: pa.RecordBatch, place: int, limit: int = 128 * PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes, or one longer text."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(size) // limit
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text starts; the last entry is the end."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[starts[0]:starts[-1]], starts - starts[0]


def packs(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of rows (first, end, parts): short texts share one part, a longer text comes in several of one text each.

    A part is bytes and starts as ``raw`` gives them. Counts over a text are the sum over its parts.
    """
    data, starts = raw(column)
    first, rows = 0, len(column)
    while first < rows:
        end = int(np.searchsorted(starts, starts[first] + limit, side="right")) - 1
        if end > first:
            yield first, end, [(data[starts[first]:starts[end]], starts[first:end + 1] - starts[first])]
        else:
            end, a, b = first + 1, int(starts[first]), int(starts[first + 1])
            cuts = [*range(a, b, limit), b]
            yield first, end, [(data[x:y], np.array([0, y - x])) for x, y in zip(cuts, cuts[1:])]
        first = end


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: Sequence[int], max_chars: int
) -> DataFrame:
    """Texts of at most ``per_class[v]`` labelled documents of each class v, picked by a hash of their id.

    ``allowed`` says which ids may be learned from. Texts over ``max_chars`` characters are not sampled, so the sample
    is bounded in bytes too. Ids with labels of both classes are left out; of repeated documents one stays.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(
        F.min(label).alias("y"), F.max(label).alias("__top")
    ).filter((F.col("y") == F.col("__top")) & allowed)
    picked = None
    for value, most in enumerate(per_class):
        some = one.filter(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "y")
        picked = some if picked is None else picked.union(some)
    # At most sum(per_class) ids: a bound that does not depend on the data.
    texts = docs.select("doc_id", "text").filter(F.length("text") <= max_chars)
    found = texts.join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
