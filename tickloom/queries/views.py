"""Queries for the view compiler: the seven stated views on the driver's tables, and its options."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.ordering import numbered
from tickloom.plans.view import view
from tickloom.queries.registry import dominant_sql, last_sql, mean_sql, money, query, table, view_sql

STATUSES = ["F", "O", "P"]
KINDS = ["click", "error", "purchase", "signup", "view"]


def order_ticks(spark, folder):
    """Orders as ticks: the priority is the ticker, the status the client."""
    price = money("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("ticker"), F.col("o_orderstatus").alias("client"),
        price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"),
        F.col("o_custkey").alias("volume"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("seq"),
    )


TICKS_SQL = """
    SELECT o_orderpriority AS ticker, o_orderstatus AS client, o_totalprice::DECIMAL(18,2) AS price,
        o_custkey AS volume, o_orderdate AS ts, o_orderkey AS seq FROM orders"""

PRICE_MEASURES = {
    "open": mean_sql("price"), "high": "max(price) {f}::DOUBLE", "low": "min(price) {f}::DOUBLE", "close": mean_sql("price"),
}


def as_doubles(df):
    """Decimals to doubles, which both engines hand over alike."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.select([
        (F.col(f"`{c}`").cast("double") if kind == "decimal" else F.col(f"`{c}`")).alias(c) for c, kind in kinds.items()
    ])


# The group, split, column and aggregate settings of the views below are those that have to give these results.


@query(view_sql(
    TICKS_SQL, ["ticker"],
    {"client": "count(client) {f}", **PRICE_MEASURES, "timestamp": last_sql("ts", "ts")}, STATUSES, "client",
))
def view_ticker_by_client(spark, folder):
    config = {
        "group_by": ["ticker"], "split_by": ["client"],
        "columns": ["client", "open", "high", "low", "close", "timestamp"], "filter": [], "sort": [], "expressions": {},
        "aggregates": {"high": "max", "timestamp": "last", "low": "min", "open": "mean", "ticker": "dominant", "close": "mean"},
    }
    return as_doubles(view(order_ticks(spark, folder), config, order_by=["timestamp"]))


@query(view_sql(
    "SELECT event_type AS ticker, user_id AS client, value::DECIMAL(18,2) AS price, ts FROM events", ["ticker"],
    {"ticker_dominant": dominant_sql("ticker"), "client": "(sum(client) {f})::BIGINT", **PRICE_MEASURES,
     "lastUpdate": last_sql("ts", "ts"), "price": last_sql("price", "ts") + "::DOUBLE"},
))
def view_last_update(spark, folder):
    price = money("value")
    ticks = table(spark, folder, "events").select(
        F.col("event_type").alias("ticker"), F.col("user_id").alias("client"), price.alias("open"), price.alias("high"),
        price.alias("low"), price.alias("close"), price.alias("price"), F.col("ts").alias("lastUpdate"),
    )
    config = {
        "group_by": ["ticker"], "columns": ["ticker", "client", "open", "high", "low", "close", "lastUpdate", "price"],
        "aggregates": {"high": "max", "lastUpdate": "last", "low": "min", "open": "mean", "ticker": "dominant",
                       "close": "mean", "price": "last"},
    }
    return as_doubles(view(ticks, config, order_by=["lastUpdate"]))


@query(view_sql(
    TICKS_SQL, ["ticker", "client"],
    {"timestamp": last_sql("ts", "ts"), "ticker_count": "count(ticker) {f}", "client_dominant": dominant_sql("client"),
     "open": mean_sql("price"), "high": mean_sql("price"), "low": mean_sql("price"), "close": mean_sql("price"),
     "volume": "(sum(volume) {f})::BIGINT", "date": dominant_sql("strftime(ts, '%Y-%m-%d')")},
))
def view_ticker_client_levels(spark, folder):
    ticks = order_ticks(spark, folder).withColumn("date", F.date_format("timestamp", "yyyy-MM-dd"))
    config = {
        "group_by": ["ticker", "client"], "split_by": [],
        "columns": ["timestamp", "ticker", "client", "open", "high", "low", "close", "volume", "date"],
        "aggregates": {"low": "avg", "timestamp": "last", "open": "mean", "client": "dominant", "close": "avg",
                       "date": "dominant", "high": "avg"},
    }
    return as_doubles(view(ticks, config, order_by=["timestamp"]))


@query(view_sql(
    """SELECT user_id AS location, event_type AS phase, CAST(event_id % 10 AS INTEGER) AS groupid,
        value::DECIMAL(18,2) AS price, ts FROM events""", ["location"],
    {"ts": last_sql("ts", "ts"), "current": mean_sql("price"), "voltage": mean_sql("price"), "phase": last_sql("phase", "ts"),
     "location_dominant": dominant_sql("location"), "groupid": "count(groupid) {f}"},
))
def view_meters(spark, folder):
    meters = table(spark, folder, "events").select(
        "ts", money("value").alias("current"), money("value").alias("voltage"), F.col("event_type").alias("phase"),
        F.col("user_id").alias("location"), (F.col("event_id") % 10).cast("int").alias("groupid"),
    )
    config = {
        "group_by": ["location"], "columns": ["ts", "current", "voltage", "phase", "location", "groupid"],
        "aggregates": {"phase": "last", "groupid": "count", "voltage": "mean", "ts": "last", "location": "dominant",
                       "current": "mean"},
    }
    return view(meters, config, order_by=["ts"])


@query(view_sql(
    "SELECT user_id AS station_name, event_type AS status, value::DECIMAL(18,2) AS price, event_id, ts FROM events",
    ["station_name"],
    {"longitude": last_sql("price", "ts") + "::DOUBLE", "latitude": last_sql("event_id", "ts"),
     "energy_consumption": mean_sql("price"),
     "ts1": "count(date_trunc('minute', ts)) {f}"}, KINDS, "status",
))
def view_stations_by_status(spark, folder):
    grid = table(spark, folder, "events").select(
        F.col("user_id").alias("station_name"), F.col("event_type").alias("status"), money("value").alias("longitude"),
        F.col("event_id").alias("latitude"), money("value").alias("energy_consumption"), F.col("ts").alias("_time"),
    )
    config = {
        "group_by": ["station_name"], "split_by": ["status"],
        "columns": ["longitude", "latitude", None, "energy_consumption", None, "ts1"],
        "expressions": {"ts1": "bucket(\"_time\", '1m')"},
        "aggregates": {"latitude": "last", "energy_consumption": "mean", "longitude": "last"},
    }
    return as_doubles(view(grid, config, order_by=["_time"], splits=KINDS))


@query(view_sql(
    """SELECT p_brand, p_type, l_suppkey, l_shipdate, l_quantity::DECIMAL(18,2) AS l_quantity,
        l_extendedprice::DECIMAL(18,2) AS sales, l_returnflag AS city FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ["p_brand", "p_type"],
    {"l_suppkey": "(sum(l_suppkey) {f})::BIGINT", "l_shipdate": last_sql("l_shipdate", "l_shipdate"),
     "l_quantity": "(sum(l_quantity) {f})::DOUBLE", "sales": "(sum(sales) {f})::DOUBLE", "city": dominant_sql("city")},
))
def view_category_levels(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", "l_shipdate", money("l_quantity").alias("l_quantity"),
        money("l_extendedprice").alias("sales"), F.col("l_returnflag").alias("city"),
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    store = lines.join(parts, lines.l_partkey == parts.p_partkey)
    config = {
        "group_by": ["p_brand", "p_type"], "columns": ["l_suppkey", "l_shipdate", "l_quantity", "sales", "city"],
        "aggregates": {"city": "dominant", "l_shipdate": "last"},
    }
    return as_doubles(view(store, config, order_by=["l_shipdate"]))


@query(view_sql(
    "SELECT c_nationkey, c_mktsegment, c_acctbal::DECIMAL(18,2) AS c_acctbal, c_name FROM customer", ["c_nationkey"],
    {"c_mktsegment": "count(c_mktsegment) {f}", "c_acctbal": "(sum(c_acctbal) {f})::DOUBLE", "c_name": "count(c_name) {f}"},
))
def view_state_defaults(spark, folder):
    customers = table(spark, folder, "customer").withColumn("c_acctbal", money("c_acctbal"))
    config = {"group_by": ["c_nationkey"], "columns": ["c_mktsegment", "c_acctbal", "c_name"]}
    return as_doubles(view(customers, config))


@query(view_sql(
    "SELECT event_type, user_id, value::DECIMAL(18,2) AS value, ts FROM events", ["event_type", "user_id"],
    {"value": "max(value) {f}::DOUBLE", "ts": "min(ts) {f}"}, levels=[2],
))
def view_leaf_levels(spark, folder):
    events = table(spark, folder, "events").withColumn("value", money("value"))
    config = {"group_by": ["event_type", "user_id"], "columns": ["value", "ts"], "aggregates": {"value": "max", "ts": "min"}}
    return as_doubles(view(events, config, levels="leaf"))


@query("""
    SELECT CASE WHEN GROUPING(event_type) = 0 THEN 1 ELSE 0 END AS __level, event_type, user_id,
        sum(value::DECIMAL(18,2))::DOUBLE AS value, count(ts) AS ts
    FROM events GROUP BY GROUPING SETS ((event_type, user_id), (user_id))""")
def view_split_rows(spark, folder):
    events = table(spark, folder, "events").withColumn("value", money("value"))
    config = {"group_by": ["event_type"], "split_by": ["user_id"], "columns": ["value", "ts"]}
    return as_doubles(view(events, config, layout="rows"))


@query("""
    WITH g AS (SELECT CASE WHEN GROUPING(o_orderpriority) = 0 THEN 1 ELSE 0 END AS __level, o_orderpriority,
        sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS o_totalprice, count(o_orderstatus) AS o_orderstatus
        FROM orders WHERE o_totalprice >= 250000 GROUP BY ROLLUP (o_orderpriority))
    SELECT *, row_number() OVER (ORDER BY __level, o_totalprice DESC) - 1 AS place FROM g""")
def view_sorted(spark, folder):
    orders = table(spark, folder, "orders").withColumn("o_totalprice", money("o_totalprice"))
    config = {
        "group_by": ["o_orderpriority"], "columns": ["o_totalprice", "o_orderstatus"],
        "filter": [["o_totalprice", ">=", 250000]], "sort": [["o_totalprice", "desc"]],
    }
    return as_doubles(numbered(view(orders, config), "place"))


@query("""
    SELECT event_id, value * 2 AS twice, time_bucket(INTERVAL 5 MINUTE, ts) AS slot FROM events WHERE value * 2 > 10""")
def view_expressions(spark, folder):
    config = {
        "columns": ["event_id", "twice", "slot"], "expressions": {"twice": "value * 2", "slot": "bucket(\"ts\", '5m')"},
        "filter": [["twice", ">", 10]],
    }
    return view(table(spark, folder, "events"), config)
