"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import NUMBER_PATTERN, slug, to_int_fill, to_numeric_coerce

CORRUPT = "__corrupt"
# Cells as other programs write them: quotes doubled, spaces kept, an empty text told from null by its quotes.
CSV_CELLS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
TIMESTAMP_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _typed(field: T.StructField, timestamp_format: str | None, date_format: str | None) -> Column:
    """A text column in its declared type, null where the text does not fit."""
    text, kind = F.col(field.name), field.dataType
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        special = F.lower(F.trim(text)).isin("nan", "inf", "+inf", "-inf", "infinity", "-infinity")
        return F.when(text.rlike(NUMBER_PATTERN) | special, F.trim(text).try_cast(kind))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and timestamp_format:
        return F.try_to_timestamp(text, F.lit(timestamp_format)).cast(kind)
    if isinstance(kind, T.DateType) and date_format:
        return F.try_to_timestamp(text, F.lit(date_format)).cast(kind)
    return F.trim(text).try_cast(kind)


def quoted_breaks(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """Whether a quoted cell may hold a line break: then some line has an odd number of quotes, as doubled ones come in pairs."""
    if encoding.upper() not in ("UTF-8", "US-ASCII", "ISO-8859-1"):
        return True  # lines cannot be told apart byte by byte
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).filter(quotes % 2 == 1).head(1))


def read_csv_checked(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = ",",
    timestamp_format: str | None = None,
    date_format: str | None = None,
    flag: str = "rejected",
    encoding: str = "UTF-8",
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with a header as declared types and a flag on rows with a value that does not fit, or too few or many cells.

    Quotes within a quoted cell are doubled, cells may hold line breaks, spaces count, and a quoted empty cell is an
    empty text where a bare one is null. The file is read as text and converted here: Spark's own check looks only at
    the columns a query uses, so whether a row counts as bad would depend on the query. gzip is recognised by file name.
    Large files are split between tasks unless a cell may hold a line break; a pass over the lines finds that out, which
    stating ``multi_line`` saves.
    """
    if multi_line is None:
        multi_line = quoted_breaks(spark, path, encoding)
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField(CORRUPT, T.StringType())])
    # A bare empty cell is read as this null mark, which no text holds, so that it differs from a quoted one.
    settings = {**CSV_CELLS, "nullValue": "\0", "emptyValue": "", "sep": sep, "encoding": encoding, "multiLine": str(multi_line).lower(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    raw = spark.read.option("header", "true").options(**settings).schema(text).csv(path)
    typed = [_typed(f, timestamp_format, date_format).alias(f"__typed_{i}") for i, f in enumerate(schema.fields)]
    # Out of a generator the converted row is a value: a filter on the flag does not repeat the work.
    rows = raw.select("*", F.inline(F.array(F.struct(*typed))))
    bad = F.col(CORRUPT).isNotNull()
    for i, field in enumerate(schema.fields):
        bad = bad | (F.col(field.name).isNotNull() & F.col(f"__typed_{i}").isNull())
    columns = [F.col(f"__typed_{i}").alias(f.name) for i, f in enumerate(schema.fields)]
    return rows.select(*columns, bad.alias(flag))


def read_csv_typed(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = ",",
    timestamp_format: str | None = None,
    date_format: str | None = None,
    **layout: str | bool,
) -> DataFrame:
    """CSV with a header and declared types; a row that does not fit is left out."""
    rows = read_csv_checked(spark, path, schema, sep, timestamp_format, date_format, "__rejected", **layout)
    return rows.filter(~F.col("__rejected")).drop("__rejected")


# The key of the daily series in a provider's document and its fields, in their order.
SERIES_KEY = "Time Series (Daily)"
SERIES_FIELDS = {
    "1. open": "open", "2. high": "high", "3. low": "low", "4. close": "close", "5. volume": "volume",
}


def parse_series_document(df: DataFrame, document: str, keys: Sequence[str]) -> DataFrame:
    """JSON documents ``{"Time Series (Daily)": {date: {"1. open": "150.00", ...}}}`` to one row per day.

    Prices that are not numbers become null, volumes 0. A document without a series gives no row.
    """
    schema = f"`{SERIES_KEY}` MAP<STRING, MAP<STRING, STRING>>"
    parsed = F.from_json(F.col(document), schema)[SERIES_KEY]
    days = df.select(*keys, F.explode(parsed).alias("__date", "__day"))
    day = F.col("__day")
    columns = [
        (to_int_fill(day[source]) if name == "volume" else to_numeric_coerce(day[source])).alias(name)
        for source, name in SERIES_FIELDS.items()
    ]
    return days.select(*keys, F.col("__date").try_cast("date").alias("date"), *columns)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(
    df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",", line_sep: str = "\n",
    encoding: str = "UTF-8", timestamp_format: str = TIMESTAMP_PATTERN,
) -> None:
    """Every file gets the header, so appended files read back as one table."""
    writer = df.write.mode(mode).option("header", "true").option("sep", sep).option("lineSep", line_sep)
    writer = writer.options(**CSV_CELLS, emptyValue='""', nullValue="").option("encoding", encoding).option("timestampFormat", timestamp_format)
    writer.option("timestampNTZFormat", timestamp_format).csv(path)


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite", timestamp_format: str = TIMESTAMP_PATTERN) -> None:
    """One JSON object per line, nulls included."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false").option("timestampFormat", timestamp_format)
    writer.option("timestampNTZFormat", timestamp_format).json(path)


# File formats by the ending of a path.
FORMATS = {".csv": "csv", ".parquet": "parquet", ".ndjson": "ndjson"}


def write_file(df: DataFrame, path: str, kind: str = "infer", append: bool = False, **options: str) -> None:
    """Write in the format the path's ending names, or the one stated."""
    if kind == "infer":
        found = [f for ending, f in FORMATS.items() if path.endswith(ending)]
        if not found:
            raise ValueError(f"unknown file type: {path}")
        kind = found[0]
    writers = {"csv": write_csv, "parquet": write_parquet, "ndjson": write_ndjson}
    if kind not in writers:
        raise ValueError(f"unknown file type: {kind}")
    writers[kind](df, path, "append" if append else "overwrite", **options)


def _write_partitioned(df: DataFrame, path: str, part: str, value: Column | None, order: Sequence[str], mode: str) -> None:
    """One folder per value of ``part``, rows in order within each file.

    Ranges of (part, order) rather than hashes of part: a large value spreads over several tasks
    and files, and a small one still ends up in one file.
    """
    wide = df if value is None else df.withColumn(part, value)
    ranged = wide.repartitionByRange(part, *order).sortWithinPartitions(part, *order)
    ranged.write.mode(mode).partitionBy(part).parquet(path)


def write_by_key(df: DataFrame, path: str, key: str, order: Sequence[str], mode: str = "overwrite") -> None:
    """One folder per key, rows sorted by ``order``."""
    _write_partitioned(df, path, key, None, order, mode)


def write_by_year(df: DataFrame, path: str, ts: str, order: Sequence[str], mode: str = "overwrite") -> None:
    """One folder per calendar year."""
    _write_partitioned(df, path, "year", F.year(ts), [ts, *[o for o in order if o != ts]], mode)


def write_by_slug(df: DataFrame, path: str, name: str, order: Sequence[str], mode: str = "overwrite") -> None:
    """One folder per value of a text column, named in lower case with underscores as ``<name>_slug``."""
    _write_partitioned(df, path, f"{name}_slug", slug(name), order, mode)


def create_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None, drop: bool = True) -> None:
    """An empty typed table, dropping one of the same name first if ``drop``."""
    if drop:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = spark.createDataFrame([], schema).write.mode("overwrite" if drop else "ignore").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def append_table(df: DataFrame, name: str, sort: Sequence[str] = ()) -> None:
    """Append rows in the table's types; ``sort`` orders them within each file for min/max skipping."""
    target = df.sparkSession.table(name).schema
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])
    (typed.sortWithinPartitions(*sort) if sort else typed).write.mode("append").insertInto(name)


def append_jdbc(df: DataFrame, url: str, table: str, batch_rows: int = 1000, **options: str) -> None:
    """Append to a database table. Needs the database's driver on the class path; not tested here."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_rows), **options).mode("append").save()


def show_batch(df: DataFrame, rows: int = 20, width: int = 20) -> None:
    """Print the first rows, long cells cut to ``width``."""
    df.show(rows, truncate=width)
