"""Queries for column functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import draws, scalars
from tickloom.functions.spans import latest
from tickloom.operators import filters, tables
from tickloom.plans.view import view
from tickloom.queries.registry import query, table


@query("SELECT c_custkey AS client_id, c_name AS client, c_mktsegment AS sector FROM customer")
def rename_columns(spark, folder):
    renamed = tables.rename_columns(
        table(spark, folder, "customer"), {"c_custkey": "client_id", "c_name": "client", "c_mktsegment": "sector"}
    )
    return renamed.select("client_id", "client", "sector")


@query("""
    WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber,
        CASE WHEN l_linenumber = 3 THEN 'n/a' WHEN l_linenumber = 5 THEN '12d'
             ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,4)) + 0.0011 AS VARCHAR) END AS price FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber, round(try_cast(price AS DOUBLE), 2) AS price FROM t""")
def to_numeric_coerce(spark, folder):
    exact = F.col("l_extendedprice").cast("decimal(18,4)") + F.lit("0.0011").cast("decimal(18,4)")
    text = (
        F.when(F.col("l_linenumber") == 3, "n/a").when(F.col("l_linenumber") == 5, "12d").otherwise(exact.cast("string"))
    )
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", text.alias("price"))
    return rows.withColumn("price", scalars.to_numeric_coerce("price"))


@query("""
    WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE l_linenumber
        WHEN 1 THEN CAST(l_partkey AS VARCHAR) WHEN 2 THEN l_partkey || '.75' WHEN 3 THEN 'n/a'
        WHEN 4 THEN '-' || l_partkey || '.75' ELSE '' END AS v FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber,
           coalesce(CAST(trunc(try_cast(v AS DOUBLE)) AS BIGINT), 0) AS volume FROM t""")
def to_int_fill(spark, folder):
    line, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    text = (
        F.when(line == 1, part).when(line == 2, F.concat(part, F.lit(".75"))).when(line == 3, "n/a")
        .when(line == 4, F.concat(F.lit("-"), part, F.lit(".75"))).otherwise("")
    )
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", scalars.to_int_fill(text).alias("volume")
    )


@query("""
    WITH dim AS (SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
    SELECT c_custkey, c_nationkey, coalesce(n_name, 'Unknown') AS n_name
    FROM customer LEFT JOIN dim ON c_nationkey = n_nationkey""")
def enrich_lookup(spark, folder):
    region = table(spark, folder, "region").filter("r_name <> 'ASIA'")
    nation = table(spark, folder, "nation")
    dim = nation.join(region, nation.n_regionkey == region.r_regionkey, "left_semi")
    dim = dim.withColumnRenamed("n_nationkey", "c_nationkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return tables.lookup_join(customers, dim, "c_nationkey", {"n_name": "Unknown"})


@query("""
    SELECT c_custkey, list_value(c_mktsegment, 'ALL', c_name)[
        1 + CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 3] AS picked FROM customer""")
def pick_from_array(spark, folder):
    choices = F.array("c_mktsegment", F.lit("ALL"), "c_name")
    return table(spark, folder, "customer").select(
        "c_custkey", draws.pick_from_array(choices, "c_custkey").alias("picked")
    )


@query("SELECT event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events")
def to_date(spark, folder):
    return table(spark, folder, "events").select("event_id", scalars.to_date("ts").cast("string").alias("day"))


@query("SELECT event_id, 'trades' AS measurement, ts, value FROM events")
def select_insert_columns(spark, folder):
    rows = tables.select_columns(table(spark, folder, "events"), ["event_id", "ts", "value"])
    return tables.insert_column(rows, 1, "measurement", "trades")


@query("""
    SELECT event_id, CASE WHEN event_type IN ('error', 'click', 'view') THEN NULL ELSE value END AS value FROM events""")
def null_non_finite(spark, folder):
    kind = F.col("event_type")
    odd = (
        F.when(kind == "error", F.lit(float("nan"))).when(kind == "click", F.lit(float("inf")))
        .when(kind == "view", F.lit(float("-inf"))).otherwise(F.col("value"))
    )
    return table(spark, folder, "events").select("event_id", scalars.null_non_finite(odd).alias("value"))


@query("""
    SELECT CAST(event_id AS DOUBLE) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, event_type, value FROM events""")
def iso_strings(spark, folder):
    return tables.json_ready(table(spark, folder, "events").select("event_id", "ts", "event_type", "value"))


@query("""
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN ts
        ELSE date_trunc('second', ts) - INTERVAL 2 HOUR END AS parsed FROM events""")
def parse_timestamps(spark, folder):
    kind = F.col("event_type")
    fine = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" +0000"))
    coarse = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0200"))
    text = F.when(kind == "error", "yesterday").when(kind == "click", fine).otherwise(coarse)
    rows = table(spark, folder, "events").select("event_id", text.alias("text"))
    parsed = scalars.parse_timestamps("text", on_error="null").cast("timestamp_ntz")
    return rows.select("event_id", parsed.alias("parsed"))


@query("""
    SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) * 1000 AS ns, date_trunc('millisecond', ts) AS from_ms,
        ts AS from_ns, ts - INTERVAL 330 MINUTE AS utc FROM events""")
def epoch_convert(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "ts", scalars.epoch_ms("ts").alias("ms"), scalars.epoch_ns("ts").alias("ns"))
    return rows.select(
        "event_id", "ms", "ns",
        scalars.from_epoch_ms("ms").cast("timestamp_ntz").alias("from_ms"),
        scalars.from_epoch_ns("ns").cast("timestamp_ntz").alias("from_ns"),
        scalars.local_to_utc("ts", "+05:30").cast("timestamp_ntz").alias("utc"),
    )


@query("""
    SELECT event_id, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter_hour,
        date_trunc('week', ts) AS week, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month,
        CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS quarter FROM events""")
def bucket(spark, folder):
    spans = {"minute": "1m", "quarter_hour": "15m", "week": "1w", "month": "1mo", "quarter": "3mo"}
    return table(spark, folder, "events").select(
        "event_id", *[scalars.bucket("ts", span, "timestamp_ntz").alias(name) for name, span in spans.items()]
    )


@query("SELECT o_orderkey, replace(lower(o_orderpriority), ' ', '_') AS slug FROM orders")
def slug(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", scalars.slug("o_orderpriority").alias("slug"))


@query("""
    SELECT l_orderkey, l_partkey, l_linenumber, (l_extendedprice + l_tax) - l_extendedprice AS spread,
        (l_extendedprice + (l_extendedprice + l_tax)) / 2 AS mid, l_extendedprice * l_quantity AS notional,
        CAST(floor(l_quantity / 8.0) AS BIGINT) AS trade_count FROM lineitem""")
def quote_metrics(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("ask", F.col("l_extendedprice") + F.col("l_tax"))
    return rows.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        scalars.spread("l_extendedprice", "ask").alias("spread"),
        scalars.mid("l_extendedprice", "ask").alias("mid"),
        scalars.notional("l_extendedprice", "l_quantity").alias("notional"),
        scalars.trade_count("l_quantity", 8.0).alias("trade_count"),
    )


@query("""
    SELECT l_orderkey, l_partkey, l_linenumber, l_quantity * l_extendedprice AS trade_value,
        l_quantity * l_extendedprice * CASE l_returnflag WHEN 'A' THEN CAST(0.002 AS DOUBLE)
            WHEN 'N' THEN CAST(0.0015 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END AS commission,
        l_quantity * l_extendedprice * CASE l_linestatus WHEN 'F' THEN CAST(0.0007 AS DOUBLE)
            ELSE CAST(0.0005 AS DOUBLE) END AS venue_fee FROM lineitem""")
def execution_costs(spark, folder):
    traders = spark.createDataFrame([("A", 0.002), ("N", 0.0015)], "l_returnflag string, rate double")
    venues = spark.createDataFrame([("F", 0.0007)], "l_linestatus string, rate double")
    costed = tables.execution_costs(
        table(spark, folder, "lineitem"), traders, venues, "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus", digits=None,
    )
    return costed.select("l_orderkey", "l_partkey", "l_linenumber", "trade_value", "commission", "venue_fee")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(c_acctbal) AS qty FROM customer")
def side_from_sign(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", scalars.side_from_sign("c_acctbal").alias("side"), F.abs("c_acctbal").alias("qty")
    )


@query("""
    WITH t AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'BUY' ELSE 'SELL' END AS side FROM lineitem),
    p AS (SELECT *, CASE side WHEN 'BUY' THEN (l_extendedprice + 1) + l_discount ELSE l_extendedprice - l_discount END AS price FROM t)
    SELECT l_orderkey, l_partkey, l_linenumber, side, price,
        CASE side WHEN 'BUY' THEN price * (1 + l_tax) ELSE price * (1 - l_tax) END AS limit_price FROM p""")
def limit_and_price(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "*", F.when(F.col("l_returnflag") == "A", "BUY").otherwise("SELL").alias("side"),
        (F.col("l_extendedprice") + 1).alias("ask"),
    )
    priced = rows.withColumn("price", scalars.fill_price("side", "l_extendedprice", "ask", "l_discount"))
    return priced.select(
        "l_orderkey", "l_partkey", "l_linenumber", "side", "price",
        scalars.limit_price("side", "price", "l_tax").alias("limit_price"),
    )


@query("""
    SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS INTEGER) AS user_id, ts,
        CAST(value AS FLOAT) AS value FROM events""")
def enforce_schema(spark, folder):
    schema = T.StructType.fromDDL("event_id STRING, user_id INT, ts TIMESTAMP_NTZ, value FLOAT")
    return tables.enforce_schema(table(spark, folder, "events"), schema)


@query("""
    SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE value / CAST(user_id % 5 AS DOUBLE) END AS current,
        60 + value AS battery_soc, user_id + value * 1000 AS renewable FROM events""")
def power_metrics(spark, folder):
    rows = table(spark, folder, "events").withColumn("voltage", F.col("user_id") % 5)
    return rows.select(
        "event_id", scalars.current("value", "voltage").alias("current"),
        scalars.state_of_charge("value").alias("battery_soc"),
        scalars.renewable_power("user_id", "value").alias("renewable"),
    )


@query("""
    SELECT o_orderkey, date_trunc('day', o_orderdate) + to_seconds(34200 +
        CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 23401) AS event_ts FROM orders""")
def session_timestamp(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", scalars.session_timestamp("o_orderdate", draws.key_hash("o_orderkey")).cast("timestamp_ntz").alias("event_ts")
    )


@query("SELECT event_id, ts + to_microseconds((user_id % 32) * 31250) AS ts FROM events")
def stagger_timestamps(spark, folder):
    moved = scalars.stagger_timestamp("ts", F.col("user_id") % 32, 32, "1s")
    return table(spark, folder, "events").select("event_id", moved.cast("timestamp_ntz").alias("ts"))


# --- filters ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def filter_eq(spark, folder):
    kept = filters.filter_eq(table(spark, folder, "orders"), {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"})
    return kept.select("o_orderkey", "o_totalprice")


@query("""
    WITH m AS (SELECT max(ts) AS m FROM events)
    SELECT event_id, ts, value FROM events, m WHERE ts >= m - INTERVAL 7 DAY AND ts < m + INTERVAL 1 SECOND""")
def range_filter(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "value")
    return filters.range_filter(events, "ts", "-7d", "1s", as_of=latest(events, "ts"))


@query("""
    SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderdate >= date_trunc('day', (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 YEAR)""")
def time_span_filter(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return filters.time_span_filter(orders, "o_orderdate", "1y", as_of=latest(orders, "o_orderdate"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'click' OR event_type = 'view'")
def filter_any(spark, folder):
    return filters.filter_any(table(spark, folder, "events"), "event_type", ["click", "view"]).select(
        "event_id", "event_type", "value"
    )


@query("SELECT l_orderkey, l_partkey, l_linenumber - 2 AS qty FROM lineitem WHERE l_linenumber - 2 > 0")
def drop_zero(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") - 2).alias("qty"))
    return filters.drop_zero(rows, "qty", signed=False)


@query("SELECT l_orderkey, l_partkey, l_linenumber - 2 AS qty FROM lineitem WHERE l_linenumber - 2 <> 0")
def drop_zero_signed(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") - 2).alias("qty"))
    return filters.drop_zero(rows, "qty")


@query("""
    SELECT doc_id, CASE WHEN regexp_matches(text, '[Ll]icensed?') THEN 'license'
        WHEN regexp_matches(text, '[A-Za-z0-9]+@[A-Za-z0-9]+') THEN 'mail' END AS reason FROM documents""")
def reject_error_payloads(spark, folder):
    patterns = ((r"[Ll]icensed?", "license"), (r"[A-Za-z0-9]+@[A-Za-z0-9]+", "mail"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    good, bad = filters.reject_error_payloads(docs, "text", patterns)
    return tables.union_tables([good, bad]).select("doc_id", "reason")


@query("""
    SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderdate FROM orders
    WHERE o_totalprice > 1500 AND o_totalprice <= 400000 AND o_orderstatus IN ('F', 'O') AND o_orderstatus <> 'P'
      AND o_orderpriority NOT IN ('5-LOW') AND contains(o_orderpriority, 'E') AND starts_with(o_orderpriority, '4')
      AND ends_with(o_orderpriority, 'ED') AND o_orderdate IS NOT NULL""")
def view_filter(spark, folder):
    config = {
        "columns": ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate"],
        "filter": [
            ["o_totalprice", ">", 1500], ["o_totalprice", "<=", 400000], ["o_orderstatus", "in", ["F", "O"]],
            ["o_orderstatus", "!=", "P"], ["o_orderpriority", "not in", ["5-LOW"]], ["o_orderpriority", "contains", "E"],
            ["o_orderpriority", "begins with", "4"], ["o_orderpriority", "ends with", "ED"], ["o_orderdate", "is not null"],
        ],
    }
    return view(table(spark, folder, "orders"), config)
