"""Queries that read, write and read back: files, partitioned layouts, messages and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.spans import latest
from tickloom.queries.registry import money, query, table
from tickloom.queries.views import as_doubles
from tickloom.session import scratch_path
from tickloom.sources import files, messages, recent

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("""
    SELECT l_returnflag, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, max(l_shipdate) AS last
    FROM lineitem GROUP BY 1""")
def read_parquet(spark, folder):
    lines = files.read_parquet(spark, f"{folder}/lineitem.parquet")
    return as_doubles(lines.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("l_quantity")).alias("quantity"), F.max("l_shipdate").alias("last")
    ))


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderpriority <> '5-LOW'")
def read_csv_typed(spark, folder):
    """Orders as gzipped CSV with one kind of row spoiled in a column the query does not read."""
    path = scratch_path(spark, "orders-csv")
    spoiled = F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(F.col("o_custkey").cast("string"))
    orders = table(spark, folder, "orders").withColumn("o_custkey", spoiled).select(ORDER_COLUMNS)
    writer = orders.write.option("header", "true").option("compression", "gzip")
    writer.option("timestampNTZFormat", files.TIMESTAMP_PATTERN).csv(path)
    schema = table(spark, folder, "orders").select(ORDER_COLUMNS).schema
    read = files.read_csv_typed(spark, path, schema, timestamp_format=files.TIMESTAMP_PATTERN)
    return read.select("o_orderkey", "o_totalprice", "o_orderdate")


@query("""
    WITH d AS (SELECT o_orderkey AS symbol, o_orderdate AS day, o_totalprice AS p, o_custkey AS v, o_orderstatus AS s
        FROM orders WHERE o_orderpriority <> '1-URGENT'),
    r AS (SELECT symbol, day, p, v, s FROM d UNION ALL SELECT symbol, day + INTERVAL 1 DAY, p, v, s FROM d)
    SELECT symbol, strftime(day, '%Y-%m-%d') AS date, p AS open, p AS high, p AS low,
        CASE WHEN s = 'F' THEN NULL ELSE p END AS close, CASE WHEN s = 'P' THEN 0 ELSE v END AS volume FROM r""")
def parse_series_document(spark, folder):
    price = F.col("o_totalprice").cast("string")
    day = F.create_map(
        F.lit("1. open"), price, F.lit("2. high"), price, F.lit("3. low"), price,
        F.lit("4. close"), F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(price),
        F.lit("5. volume"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_custkey").cast("string")),
    )
    dates = [F.date_format(F.date_add("o_orderdate", i), "yyyy-MM-dd") for i in (0, 1)]
    series = F.struct(F.create_map(dates[0], day, dates[1], day).alias(files.SERIES_KEY))
    document = F.when(F.col("o_orderpriority") == "1-URGENT", "{}").otherwise(F.to_json(series))
    documents = table(spark, folder, "orders").select(F.col("o_orderkey").alias("symbol"), document.alias("document"))
    return files.parse_series_document(documents, "document", ["symbol"]).withColumn("date", F.col("date").cast("string"))


@query("""
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
        event_type = 'error' AS rejected, CASE WHEN event_type = 'error' THEN '{"k": oops' END AS rejected_text FROM events""")
def decode_json(spark, folder):
    value = F.when(F.col("event_type") == "error", '{"k": oops').otherwise(F.col("props"))
    incoming = table(spark, folder, "events").select("event_id", value.alias("value"))
    return messages.decode_json(incoming, T.StructType([T.StructField("k", T.LongType())]), keep=["event_id"])


EVENT_FIELDS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
])


@query("SELECT event_id, user_id, event_type, value FROM events")
def decode_json_array(spark, folder):
    rows = F.struct("event_id", "user_id", "event_type", "value")
    packed = table(spark, folder, "events").groupBy(F.expr("event_id div 50").alias("pack")).agg(
        F.to_json(F.collect_list(rows)).alias("value")
    )
    return messages.accepted(messages.decode_json_array(packed, EVENT_FIELDS))


@query("SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS event_type, value FROM events")
def encode_json(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"), "value"
    )
    text = messages.encode_json(events, timestamp_format="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    schema = T.StructType([*EVENT_FIELDS.fields, T.StructField("ts", T.TimestampNTZType())])
    return messages.accepted(messages.decode_json(text, schema))


@query("""
    WITH m AS (SELECT max(ts) AS m FROM events)
    SELECT event_id, ts, event_type, value FROM events, m WHERE ts >= m - INTERVAL 1 DAY""")
def recent_slice(spark, folder):
    events = table(spark, folder, "events")
    columns = ["event_id", "ts", "event_type", "value"]
    return recent.recent_slice(events, "ts", "1d", columns, latest(events, "ts"), ["ts", ("event_type", "desc")])


@query("""
    WITH m AS (SELECT max(ts) AS m FROM events)
    SELECT event_id, ts FROM events, m WHERE ts >= m - INTERVAL 3 DAY ORDER BY ts DESC LIMIT 500""")
def recent_slice_limited(spark, folder):
    events = table(spark, folder, "events")
    return recent.recent_slice(events, "ts", "3d", ["event_id", "ts"], latest(events, "ts"), [("ts", "desc")], 500)


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def write_parquet(spark, folder):
    path = scratch_path(spark, "part") + ".parquet"
    files.write_file(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path)
    return spark.read.parquet(path)


@query("SELECT event_id, ts, event_type, value, props FROM events UNION ALL SELECT event_id, ts, event_type, value, props FROM events")
def write_csv(spark, folder):
    path = scratch_path(spark, "events") + ".csv"
    events = table(spark, folder, "events").select("event_id", "ts", "event_type", "value", "props")
    files.write_file(events, path, sep=";")
    files.write_file(events, path, append=True, sep=";")
    return files.read_csv_typed(spark, path, events.schema, sep=";", timestamp_format=files.TIMESTAMP_PATTERN)


@query("""
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  edge, "quoted" ' ELSE '' END
        || CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text, n_chars FROM documents""")
def csv_texts(spark, folder):
    """Whole texts with line breaks, quotes, spaces at both ends, empty ones and nulls, through CSV and back."""
    path = scratch_path(spark, "texts") + ".csv"
    mark = F.col("doc_id") % 5
    start = F.when(mark == 1, F.lit(None)).when(mark == 2, '  edge, "quoted" ').otherwise("")
    docs = table(spark, folder, "documents")
    texts = docs.select("doc_id", F.concat(start, F.when(mark == 0, "").otherwise(F.col("text"))).alias("text"), "n_chars")
    files.write_file(texts, path)
    return files.read_csv_typed(spark, path, texts.schema)


@query("SELECT event_id, ts, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value FROM events")
def write_ndjson(spark, folder):
    path = scratch_path(spark, "events") + ".ndjson"
    events = table(spark, folder, "events").select(
        "event_id", "ts", F.when(F.col("event_type") != "view", F.col("value")).alias("value")
    )
    files.write_file(events, path)
    return spark.read.schema(events.schema).option("timestampNTZFormat", files.TIMESTAMP_PATTERN).json(path)


@query("SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders")
def write_by_key(spark, folder):
    path = scratch_path(spark, "by-key")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    files.write_by_key(orders, path, "o_orderpriority", ["o_orderdate", "o_orderkey"])
    return spark.read.schema(orders.schema).parquet(path)


@query("SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def write_by_year(spark, folder):
    path = scratch_path(spark, "by-year")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    files.write_by_year(orders, path, "o_orderdate", ["o_orderdate", "o_orderpriority", "o_orderkey"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderdate", "year")


@query("SELECT o_orderkey, o_orderdate, replace(lower(o_orderpriority), ' ', '_') AS o_orderpriority_slug FROM orders")
def write_by_slug(spark, folder):
    path = scratch_path(spark, "by-slug")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    files.write_by_slug(orders, path, "o_orderpriority", ["o_orderdate", "o_orderkey"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderdate", "o_orderpriority_slug")


@query("""
    SELECT o_orderstatus, 2 * count(*) AS n, 2 * sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(DISTINCT o_orderkey) AS keys
    FROM orders GROUP BY 1""")
def append_table(spark, folder):
    name = f"orders_{uuid.uuid4().hex}"
    schema = T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DecimalType(18, 2)), T.StructField("o_orderdate", T.TimestampNTZType()),
    ])
    files.create_table(spark, name, schema, scratch_path(spark, name))
    for _ in range(2):
        files.append_table(table(spark, folder, "orders"), name, sort=["o_orderdate", "o_orderkey"])
    return as_doubles(spark.table(name).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.count_distinct("o_orderkey").alias("keys")
    ))
