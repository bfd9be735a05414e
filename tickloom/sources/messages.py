"""JSON messages: decoding, encoding and the Kafka wrappers.

The Kafka connector is a separate package of Spark. The functions that read or write a topic need it
on the class path and are thin: all they add to the tested halves is ``format("kafka")``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_CORRUPT = "__corrupt"


def decode_json(df: DataFrame, schema: T.StructType, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Parse one JSON object per row. A message that does not parse has ``rejected`` true and null fields."""
    lenient = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    text = F.col(value).cast("string")
    parsed = F.from_json(text, lenient, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    # Out of a generator the parsed row is a value: a filter on it does not repeat the parsing.
    rows = df.select(*keep, text.alias("__text"), F.explode(F.array(parsed)).alias("__row"))
    bad = F.col("__row").isNull() | F.col(f"__row.{_CORRUPT}").isNotNull()
    fields = [F.when(~bad, F.col("__row")[f.name]).alias(f.name) for f in schema.fields]
    return rows.select(*keep, *fields, bad.alias("rejected"), F.when(bad, F.col("__text")).alias("rejected_text"))


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(~F.col("rejected")).drop("rejected", "rejected_text")


def rejected(decoded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return decoded.filter("rejected").select(*keep, "rejected_text")


def decode_json_array(df: DataFrame, schema: T.StructType, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Parse messages that hold an array of rows, one row out per element; a single object counts as one.

    A message that does not parse, or that has an element which does not fit, gives one row with ``rejected`` true, null
    fields and its text. ``accepted`` and ``rejected`` part the result.
    """
    lenient = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    text = F.col(value).cast("string")
    listed = F.when(F.ltrim(text).startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    parsed = F.transform(F.from_json(listed, "array<string>"), lambda x: F.from_json(x, lenient, options))
    held = df.select(*keep, text.alias("__text"), F.explode(F.array(F.struct(parsed.alias("rows")))).alias("__held"))
    rows = F.col("__held.rows")
    bad = rows.isNull() | F.exists(rows, lambda x: x.isNull() | x[_CORRUPT].isNotNull())
    none = F.array(F.lit(None).cast(lenient))
    each = held.select(*keep, "__text", bad.alias("rejected"), F.explode(F.when(bad, none).otherwise(rows)).alias("__row"))
    fields = [F.col("__row")[f.name].alias(f.name) for f in schema.fields]
    return each.select(*keep, *fields, "rejected", F.when(F.col("rejected"), F.col("__text")).alias("rejected_text"))


def encode_json(df: DataFrame, value: str = "value", keep: Sequence[str] = (), timestamp_format: str = ISO_PATTERN) -> DataFrame:
    """Each row as one JSON object: ISO timestamps, nulls included."""
    options = {"timestampFormat": timestamp_format, "timestampNTZFormat": timestamp_format, "ignoreNullFields": "false"}
    return df.select(*keep, F.to_json(F.struct(*df.columns), options).alias(value))


def kafka_json_source(
    spark: SparkSession, servers: str, topic: str, schema: T.StructType, starting: str = "earliest", **options: str
) -> DataFrame:
    """A topic of JSON objects as a stream, with rejected messages marked. Not tested without a broker."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", topic).option("startingOffsets", starting)
    return decode_json(reader.options(**options).load(), schema)


def kafka_json_sink(df: DataFrame, servers: str, topic: str, checkpoint: str | None = None, **options: str):
    """Rows to a topic, as a batch or as a started stream. Not tested without a broker."""
    messages = encode_json(df)
    settings = {"kafka.bootstrap.servers": servers, "topic": topic, **options}
    if not df.isStreaming:
        return messages.write.format("kafka").options(**settings).save()
    return messages.writeStream.format("kafka").options(**settings).option("checkpointLocation", checkpoint).start()
