"""Queries for aggregates, series, order, sets, arrays and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars, fills, nested, ordering, outages, parts, points, series, stats, tables
from tickloom.queries.registry import money, query, table
from tickloom.queries.views import as_doubles


def day_text(name):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


# --- joins and sets --------------------------------------------------------------------------------


@query("""
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE month(o_orderdate) = 3)""")
def anti_new_keys(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    march = table(spark, folder, "orders").filter(F.month("o_orderdate") == 3)
    fresh = tables.anti_new_keys(customers, march, "o_custkey")
    return fresh.withColumnRenamed("o_custkey", "c_custkey")


@query("""
    SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def union_tables(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return tables.union_tables([customers, suppliers, suppliers.limit(0)])


# --- points and windows ---------------------------------------------------------------------------


@query("""
    SELECT 'orders' AS _measurement, o_orderpriority, o_orderkey, f AS _field, v AS _value, s AS _svalue,
        epoch_us(o_orderdate) * 1000 AS _time_ns
    FROM (SELECT *, 'o_totalprice' AS f, o_totalprice AS v, NULL AS s FROM orders
          UNION ALL SELECT *, 'o_custkey', CAST(o_custkey AS DOUBLE), NULL FROM orders
          UNION ALL SELECT *, 'o_orderstatus', NULL, o_orderstatus FROM orders)""")
def to_points(spark, folder):
    return points.to_points(
        table(spark, folder, "orders"), "orders", "o_orderdate", ["o_orderpriority"],
        ["o_totalprice", "o_custkey", "o_orderstatus"], extra=["o_orderkey"],
    ).drop("_time")


PRICE_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""
    SELECT l_returnflag, l_linestatus, l_orderkey, l_partkey, l_linenumber, epoch_us(l_shipdate) * 1000 AS _time_ns,
        max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount,
        max(l_tax) AS l_tax FROM lineitem GROUP BY ALL""")
def pivot_fields(spark, folder):
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    long = points.to_points(
        table(spark, folder, "lineitem"), "lines", "l_shipdate", ["l_returnflag", "l_linestatus"], PRICE_FIELDS, extra=keys
    )
    return points.pivot_fields(long, ["l_returnflag", "l_linestatus", *keys, "_time_ns"], PRICE_FIELDS)


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus, o_custkey, o_totalprice FROM orders")
def points_round_trip(spark, folder):
    """Orders to points and back: text, whole numbers and prices as they were."""
    fields = {"o_orderstatus": "string", "o_custkey": "bigint", "o_totalprice": "double"}
    orders = table(spark, folder, "orders")
    long = points.to_points(orders, "orders", "o_orderdate", ["o_orderpriority"], list(fields), extra=["o_orderkey"])
    kind = orders.schema["o_custkey"].dataType
    wide = points.pivot_fields(long, ["o_orderkey", "o_orderpriority", "_time"], fields).drop("_time")
    return wide.withColumn("o_custkey", F.col("o_custkey").cast(kind))


@query("""
    SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ts,
        sum(value::DECIMAL(18,2))::DOUBLE / count(value) AS value FROM events GROUP BY ALL""")
def aggregate_window(spark, folder):
    events = table(spark, folder, "events").withColumn("value", money("value"))
    return points.aggregate_window(events, "ts", "1h", ["event_type"], "value", "mean", stamp="end")


def _bars(spark, folder, interval):
    events = table(spark, folder, "events").withColumn("size", money("value"))
    return as_doubles(bars.resample_bars(events, "ts", "value", interval, ["event_type"], "size"))


BARS_SQL = """
    SELECT event_type, CAST({start} AS TIMESTAMP) AS bar, arg_min(value, ts) AS open, max(value) AS high,
        min(value) AS low, arg_max(value, ts) AS close, sum(value::DECIMAL(18,2))::DOUBLE AS volume FROM events GROUP BY ALL"""


@query(BARS_SQL.format(start="time_bucket(INTERVAL 15 MINUTE, ts)"))
def resample_bars_15min(spark, folder):
    return _bars(spark, folder, "15min")


@query(BARS_SQL.format(start="date_trunc('day', ts)"))
def resample_bars_daily(spark, folder):
    return _bars(spark, folder, "daily")


@query(BARS_SQL.format(start="date_trunc('week', ts)"))
def resample_bars_weekly(spark, folder):
    return _bars(spark, folder, "weekly")


@query(BARS_SQL.format(start="date_trunc('month', ts)"))
def resample_bars_monthly(spark, folder):
    return _bars(spark, folder, "monthly")


# --- statistics -----------------------------------------------------------------------------------


@query("""
    WITH c AS (SELECT DISTINCT event_type FROM events UNION SELECT 'refund'),
    n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, coalesce(n, 0) AS n, round(100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM events), 4) AS percent
    FROM c LEFT JOIN n USING (event_type)""")
def value_shares(spark, folder):
    events = table(spark, folder, "events")
    extra = events.select(F.lit("refund").alias("event_type")).limit(1)
    categories = events.select("event_type").distinct().unionByName(extra)
    return stats.value_shares(events, "event_type", categories)


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_values(spark, folder):
    return stats.distinct_values(table(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("""
    SELECT event_type, count(DISTINCT user_id) AS n_user_id, count(DISTINCT day) AS n_day
    FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) GROUP BY 1""")
def distinct_counts(spark, folder):
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return stats.distinct_counts(events, ["user_id", "day"], ["event_type"])


@query("""
    SELECT count(*) AS rows, min(ts) AS first, max(ts) AS last, sum(value::DECIMAL(18,2))::DOUBLE / count(value) AS mean_value,
        sum(value::DECIMAL(18,2))::DOUBLE AS total_value FROM events""")
def summary(spark, folder):
    events = table(spark, folder, "events").withColumn("value", money("value"))
    return as_doubles(stats.summary(events, "ts", ["value"], ["value"]))


def _segment_nations(spark, folder):
    customers, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customers.join(nation, customers.c_nationkey == nation.n_nationkey).select("c_mktsegment", "n_name")


@query("""
    SELECT c_mktsegment, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS members
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def members_by_group(spark, folder):
    found = stats.members_by_group(_segment_nations(spark, folder), "c_mktsegment", "n_name")
    return found.select("c_mktsegment", F.array_join("members", ",").alias("members"))


@query("SELECT DISTINCT event_type, user_id FROM events")
def member_rows(spark, folder):
    return stats.member_rows(table(spark, folder, "events"), "event_type", "user_id")


# --- series ----------------------------------------------------------------------------------------


@query("""
    SELECT o_custkey, o_orderkey, CAST(round_even(coalesce(v - lag(v) OVER w, 0) * CAST(0.01 AS DOUBLE), 0) AS BIGINT) AS order_qty
    FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def signed_delta(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.floor("o_totalprice").alias("volume"))
    delta = series.signed_delta(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "volume")
    return delta.select("o_custkey", "o_orderkey", "order_qty")


RUNNING_SQL = """
    SELECT event_id, event_type, 100000 + row_number() OVER (PARTITION BY event_type ORDER BY ts) AS running_id FROM events"""


@query(RUNNING_SQL)
def running_id(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "ts")
    return series.running_id(events, ["event_type"], ["ts"], 100_000).drop("ts")


@query(RUNNING_SQL)
def running_id_long_series(spark, folder):
    """The same with every series long enough to be cut into slices."""
    events = table(spark, folder, "events").select("event_id", "event_type", "ts")
    return series.running_id(events, ["event_type"], ["ts"], 100_000, rows_per_slice=500).drop("ts")


ROLLING_SQL = """
    SELECT event_id, CASE WHEN row_number() OVER w >= 10 THEN (sum(value::DECIMAL(18,2)) OVER (
        PARTITION BY event_type ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))::DOUBLE / 10 ELSE 0 END AS smooth
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)"""


@query(ROLLING_SQL)
def rolling_mean(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "ts", money("value").alias("value"))
    return series.rolling_mean(events, ["event_type"], ["ts"], "value", 10).select("event_id", "smooth")


@query(ROLLING_SQL)
def rolling_mean_long_series(spark, folder):
    """The same with every series long enough to be cut into tiles."""
    events = table(spark, folder, "events").select("event_id", "event_type", "ts", money("value").alias("value"))
    smooth = series.rolling_mean(events, ["event_type"], ["ts"], "value", 10, rows_per_slice=500)
    return smooth.select("event_id", "smooth")


@query("""
    WITH t AS (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS rn,
        count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS n FROM events)
    SELECT event_id, round(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE pow(0.1::DOUBLE, (rn - 1) / (n - 1)::DOUBLE) END, 9) AS weight FROM t""")
def log_rank_weights(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.to_date("ts").alias("day"))
    weighted = series.log_rank_weights(events, ["day"], ["event_id"])
    return weighted.select("event_id", F.round("weight", 9).alias("weight"))


@query("""
    SELECT event_id, CAST(value::DECIMAL(18,2) AS DOUBLE) / CAST(sum(value::DECIMAL(18,2)) OVER (PARTITION BY user_id) AS DOUBLE) AS share
    FROM events""")
def normalise_weights(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", money("value").alias("value"))
    return parts.normalise_weights(events, ["user_id"], "value").select("event_id", "share")


@query("""
    WITH t AS (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS total, 1 + p_size % 7 AS k FROM part)
    SELECT p_partkey, CAST(i AS INTEGER) AS part_no, CASE WHEN i = k THEN total - (total // k) * (k - 1) ELSE total // k END AS part
    FROM (SELECT *, unnest(generate_series(1, k)) AS i FROM t)""")
def equal_parts(spark, folder):
    rows = table(spark, folder, "part").select(
        "p_partkey", F.floor("p_retailprice").alias("total"), (1 + F.col("p_size") % 7).alias("k")
    )
    return parts.equal_parts(rows, "total", "k").select("p_partkey", "part_no", "part")


RANDOM_PARTS_SQL = """
    WITH s AS (SELECT event_id, user_id, value::DECIMAL(18,2)::DOUBLE
        / (sum(value::DECIMAL(18,2)) OVER (PARTITION BY user_id))::DOUBLE * 10000::DOUBLE AS x,
        max(event_id) OVER (PARTITION BY user_id) AS last FROM events),
    r AS (SELECT *, CAST(round_even(x, 0) AS BIGINT) AS part FROM s)
    SELECT event_id, CAST(CASE WHEN event_id = last THEN 10000 - coalesce(sum(part) FILTER (WHERE event_id <> last)
        OVER (PARTITION BY user_id), 0) ELSE part END AS BIGINT) AS part FROM r"""


@query(RANDOM_PARTS_SQL)
def random_parts(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", "user_id", money("value").alias("value"), F.lit(10_000).cast("bigint").alias("total")
    )
    return parts.random_parts(events, ["user_id"], "event_id", "total", "value").select("event_id", "part")


# --- order ------------------------------------------------------------------------------------------


@query("""
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderpriority, o_orderkey) + 10000 AS trade_id FROM orders""")
def sequential_id(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return ordering.sequential_id(orders, ["o_orderdate", "o_orderpriority", "o_orderkey"]).select("o_orderkey", "trade_id")


@query("""
    SELECT event_id, row_number() OVER (ORDER BY event_type, value DESC, event_id) - 1 AS position FROM events""")
def sort_multi(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    order = ["event_type", ("value", "desc"), "event_id"]
    return ordering.numbered(ordering.sort_multi(events, order)).select("event_id", "position")


@query("SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def latest_n(spark, folder):
    return ordering.latest_n(table(spark, folder, "events").select("event_id", "ts", "value"), "ts", 1000, ["event_id"])


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def head(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return ordering.head(events, 20, [("value", "desc"), "event_id"])


@query("""
    SELECT o_orderkey, o_totalprice FROM orders
    ORDER BY CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT), o_orderkey LIMIT 100""")
def sample_n(spark, folder):
    return ordering.sample_n(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


# --- arrays and days ---------------------------------------------------------------------------------


@query("SELECT event_id // 50 AS pack, event_id, ts, event_type FROM events")
def explode_events(spark, folder):
    packs = table(spark, folder, "events").groupBy(F.expr("event_id div 50").alias("pack")).agg(
        F.collect_list(F.struct("event_id", "ts", "event_type")).alias("events")
    )
    return nested.explode_events(packs, ["pack"], "events")


@query("""
    SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding) AS x FROM embeddings""")
def explode_values(spark, folder):
    exploded = nested.explode_values(table(spark, folder, "embeddings"), ["vec_id"], "embedding", "x", "place")
    return exploded.withColumn("place", F.col("place").cast("bigint"))


@query("""
    WITH d AS (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS day FROM orders),
    n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
    SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (day)""")
def calendar_spine(spark, folder):
    return nested.calendar_spine(table(spark, folder, "orders"), "o_orderdate").select(day_text("day"), "n")


# --- order slices and fills ------------------------------------------------------------------------


def hash_sql(key: str, slot: int = 0) -> str:
    text = f"CAST({key} AS VARCHAR)" + (f" || '#{slot // 4}'" if slot >= 4 else "")
    return f"CAST(('0x' || substr(md5({text}), {1 + 8 * (slot % 4)}, 8)) AS BIGINT)"


def unit_sql(key: str, slot: int = 0) -> str:
    return f"({hash_sql(key, slot)}::DOUBLE / 4294967296.0::DOUBLE)"


def slices_sql(source: str, qty: str, key: str, out: str) -> str:
    """Rows of ``source`` (with ``n`` = slices wanted) cut into slices."""
    def end(i: str) -> str:
        moved = f"CASE WHEN {i} = 0 OR {i} = m THEN 0::DOUBLE ELSE ({unit_sql(f'{key} || chr(124) || ({i})')} - 0.5::DOUBLE) * 0.3::DOUBLE END"
        return f"CAST(floor(({qty} - m)::DOUBLE * (({i})::DOUBLE + {moved}) / m::DOUBLE) AS BIGINT)"

    return f"""
        SELECT *, 1 + {end('i')} - {end('(i - 1)')} AS {out} FROM (
            SELECT *, unnest(generate_series(1, m)) AS i FROM (SELECT *, least(n, {qty}) AS m FROM {source} WHERE {qty} > 0))"""


@query(f"""
    WITH t AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key, CAST(floor(o_totalprice / 20000) AS BIGINT) AS qty,
        1 + o_custkey % 10 AS n FROM orders)
    SELECT o_orderkey, qty, CAST(i AS INTEGER) AS slice_no, slice_qty FROM ({slices_sql('t', 'qty', 'key', 'slice_qty')})""")
def order_slices(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.floor(F.col("o_totalprice") / 20000).alias("qty"), (1 + F.col("o_custkey") % 10).alias("n")
    )
    return fills.order_slices(orders, "qty", "n", "o_orderkey").drop("n")


@query(f"""
    SELECT event_id, CASE WHEN {unit_sql('event_id')} < 0.1::DOUBLE / 1.0::DOUBLE THEN 'NEW'
        WHEN {unit_sql('event_id')} < {0.1 + 0.2!r}::DOUBLE / 1.0::DOUBLE THEN 'PARTIALLY_FILLED'
        WHEN {unit_sql('event_id')} < {0.1 + 0.2 + 0.65!r}::DOUBLE / 1.0::DOUBLE THEN 'FILLED' ELSE 'CANCELLED' END AS order_status
    FROM events""")
def weighted_assign(spark, folder):
    events = table(spark, folder, "events").select("event_id")
    return fills.weighted_assign(events, "event_id", fills.ORDER_STATUSES, fills.STATUS_WEIGHTS, "order_status")


@query(f"""
    SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN {unit_sql('event_id', 2)} < 0.75 THEN 'a' ELSE 'b' END
        WHEN event_type = 'view' THEN CASE WHEN {unit_sql('event_id', 2)} < 0.25 THEN 'x'
            WHEN {unit_sql('event_id', 2)} < 0.5 THEN 'y' ELSE 'z' END END AS trader FROM events""")
def weighted_assign_by(spark, folder):
    preferences = spark.createDataFrame(
        [("click", ["a", "b"], [3.0, 1.0]), ("view", ["x", "y", "z"], [1.0, 1.0, 2.0])],
        "event_type string, choices array<string>, weights array<double>",
    )
    events = table(spark, folder, "events").select("event_id", "event_type")
    return fills.weighted_assign_by(events, "event_type", preferences, "event_id", "trader", 2).drop("event_type")


DESK = fills.Desk(
    traders=("Ada", "Bo", "Cy"), desks=("Cash", "Program"), venues=("XNAS", "XNYS", "ARCX"),
    funds=("Growth", "Value"), benchmarks=("S&P 500", "Russell 1000"),
)
TRADER_RATES = (("Ada", 0.002), ("Bo", 0.004), ("Cy", 0.006))
VENUE_RATES = (("XNAS", 0.002), ("XNYS", 0.004), ("ARCX", 0.008))


def daily_bars(spark, folder):
    """Orders as daily bars: one symbol per priority."""
    return table(spark, folder, "orders").groupBy(
        F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("symbol")
    ).agg(
        F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        (F.sum(money("o_totalprice")) / F.count(F.lit(1)) / 1000).cast("double").alias("close"),
        F.sum(F.floor("o_totalprice")).cast("bigint").alias("volume"),
    )


def _pick_sql(choices, slot):
    listed = ", ".join(f"'{c}'" for c in choices)
    return f"list_value({listed})[1 + {hash_sql('ckey', slot)} % {len(choices)}]"


def _chain_sql(choices, weights, unit):
    total, running, text = float(sum(weights)), 0.0, "CASE"
    for choice, weight in list(zip(choices, weights))[:-1]:
        running += weight
        text += f" WHEN {unit} < {running / total!r}::DOUBLE THEN {choice}"
    return f"{text} ELSE {choices[-1]} END"


def _rate_sql(name, rates):
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {r!r}::DOUBLE" for k, r in rates) + " END"


_U = {i: unit_sql("ckey", i) for i in range(14)}
FILLS_SQL = f"""
    WITH bars AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS symbol, max(o_totalprice) AS high,
            min(o_totalprice) AS low, CAST(sum(floor(o_totalprice)) AS BIGINT) AS volume FROM orders GROUP BY ALL),
    deltas AS (SELECT *, CAST(round_even(coalesce(volume - lag(volume) OVER (PARTITION BY symbol ORDER BY date), 0)
            * CAST(0.01 AS DOUBLE), 0) AS INTEGER) AS delta FROM bars),
    parents AS (SELECT *, abs(delta)::BIGINT AS parent_qty, symbol || '|' || strftime(date, '%Y-%m-%d') AS pkey FROM deltas WHERE delta <> 0),
    counted AS (SELECT *, {_chain_sql([str(i) for i in range(1, 11)], fills.SLICE_WEIGHTS, unit_sql('pkey', 1))} AS n FROM parents),
    children AS (SELECT *, pkey || '|' || i AS ckey FROM ({slices_sql('counted', 'parent_qty', 'pkey', 'order_qty')})),
    drawn AS (SELECT *, {_pick_sql(DESK.traders, 0)} AS trader, {_pick_sql(DESK.desks, 1)} AS desk,
        {_pick_sql(DESK.venues, 2)} AS exec_venue, {_pick_sql(DESK.funds, 3)} AS fund,
        {_pick_sql(DESK.benchmarks, 4)} AS benchmark_index, {_pick_sql(fills.ORDER_TYPES, 5)} AS order_type,
        {_chain_sql([f"'{s}'" for s in fills.ORDER_STATUSES], fills.STATUS_WEIGHTS, _U[6])} AS order_status,
        CASE WHEN ({_U[7]} < 0.2) <> (delta > 0) THEN 'BUY' ELSE 'SELL' END AS side,
        CAST(date AS TIMESTAMP) + to_seconds(34200 + {hash_sql('ckey', 8)} % 23401) AS event_ts FROM children),
    numbered AS (SELECT *, row_number() OVER (ORDER BY event_ts, symbol, date, i) + 10000 AS trade_id FROM drawn)
    SELECT CAST(trade_id AS INTEGER) AS trade_id, trader, desk, event_ts, symbol, symbol || ' Corp.' AS security_name,
        'Unknown' AS sector_gics, side, order_type, CAST(order_qty AS INTEGER) AS order_qty, order_status,
        CAST(CASE WHEN order_status = 'FILLED' THEN order_qty ELSE {hash_sql('ckey', 13)} % (order_qty + 1) END AS INTEGER) AS qty,
        exec_venue, CAST(high AS FLOAT) AS high_day, CAST(low AS FLOAT) AS low_day, fund, benchmark_index,
        CAST(parent_qty AS INTEGER) AS parent_qty FROM numbered"""
_PRICED = f"""
    SELECT *, CASE WHEN side = 'BUY' THEN (mid + spread / 2) + {_U[11]} * spread * 0.5::DOUBLE
        ELSE (mid - spread / 2) - {_U[11]} * spread * 0.5::DOUBLE END AS raw FROM (
    SELECT *, close + ({_U[10]} * 2 - 1) * spread AS mid FROM (
    SELECT *, close * (0.0001::DOUBLE + {_U[9]} * {0.001 - 0.0001!r}::DOUBLE) AS spread FROM (
    SELECT d.*, b.close FROM drawn d JOIN closes b USING (date, symbol))))"""
_CLOSES = """closes AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS symbol,
        CAST(floor(sum(o_totalprice::DECIMAL(18,2)) / 1000) AS DOUBLE) AS close FROM orders GROUP BY ALL)"""
FILL_PRICES_SQL = FILLS_SQL[:FILLS_SQL.index("numbered AS")] + f"""{_CLOSES}, priced AS ({_PRICED}),
    rounded AS (SELECT *, round(raw, 2) AS p, round(CASE WHEN side = 'BUY' THEN raw * (1 + (0.001::DOUBLE + {_U[12]} * {0.01 - 0.001!r}::DOUBLE))
        ELSE raw * (1 - (0.001::DOUBLE + {_U[12]} * {0.01 - 0.001!r}::DOUBLE)) END, 2) AS limit_p FROM priced)
    SELECT symbol, event_ts, CAST(order_qty AS INTEGER) AS order_qty, CAST(p AS FLOAT) AS price, CAST(limit_p AS FLOAT) AS limit_price,
        CAST(round(mid - spread / 2, 2) AS FLOAT) AS bid_price, CAST(round(mid + spread / 2, 2) AS FLOAT) AS ask_price,
        CAST(round(mid, 2) AS FLOAT) AS mid_price, CAST(round(spread, 4) AS FLOAT) AS spread_price,
        CAST(order_qty * p AS FLOAT) AS trade_value,
        CAST(round(order_qty * p * {_rate_sql('trader', TRADER_RATES)}, 4) AS FLOAT) AS commission,
        CAST(round(order_qty * p * {_rate_sql('exec_venue', VENUE_RATES)}, 4) AS FLOAT) AS venue_fee FROM rounded"""


def _fills(spark, bars_table, **options):
    traders = spark.createDataFrame(list(TRADER_RATES), "trader string, rate double")
    venues = spark.createDataFrame(list(VENUE_RATES), "exec_venue string, rate double")
    return fills.fills_from_bars(bars_table, DESK, traders, venues, **options)


@query(FILLS_SQL)
def fills_from_bars(spark, folder):
    table_ = _fills(spark, daily_bars(spark, folder), extras=True)
    prices = ["limit_price", "price", "trade_value", "commission", "venue_fee", "bid_price", "ask_price", "mid_price",
              "spread_price", "fill_value"]
    return table_.drop(*prices).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@query(FILL_PRICES_SQL)
def fill_prices(spark, folder):
    closes = daily_bars(spark, folder).drop("close")
    exact = table(spark, folder, "orders").groupBy(
        F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("symbol")
    ).agg(F.floor(F.sum(money("o_totalprice")) / 1000).cast("double").alias("close"))
    table_ = _fills(spark, closes.join(exact, ["date", "symbol"]), number=False)
    return table_.select(
        "symbol", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "order_qty", "price", "limit_price",
        "bid_price", "ask_price", "mid_price", "spread_price", "trade_value", "commission", "venue_fee",
    )


# Per column: symbol, choices, weights. The other symbols draw evenly.
PREFERENCES = {
    "trader": (("1-URGENT", ("Bo", "Ada"), (3.0, 1.0)), ("5-LOW", ("Cy", "Bo", "Ada"), (2.0, 1.0, 1.0))),
    "exec_venue": (("1-URGENT", ("ARCX", "XNAS"), (7.0, 1.0)), ("2-HIGH", ("XNYS",), (1.0,))),
    "fund": (("3-MEDIUM", ("Value", "Growth"), (5.0, 3.0)),),
}


def _preferred_sql(column):
    slot = fills.PREFERRED[column]
    cases = " ".join(
        f"WHEN '{symbol}' THEN {_chain_sql([repr(c) for c in choices], weights, _U[slot]) if len(choices) > 1 else repr(choices[0])}"
        for symbol, choices, weights in PREFERENCES[column]
    )
    return f"CASE symbol {cases} ELSE {column} END AS {column}"


@query(FILLS_SQL[:FILLS_SQL.index("numbered AS")] + f"""chosen AS (
    SELECT symbol, event_ts, CAST(order_qty AS INTEGER) AS order_qty, {", ".join(map(_preferred_sql, PREFERENCES))} FROM drawn)
    SELECT * FROM chosen""")
def fill_preferences(spark, folder):
    """Fills whose trader, venue and fund follow the weights of their symbol."""
    schema = "symbol string, choices array<string>, weights array<double>"
    tables = {c: spark.createDataFrame([(s, list(n), list(w)) for s, n, w in rows], schema) for c, rows in PREFERENCES.items()}
    found = _fills(spark, daily_bars(spark, folder), number=False, preferences=tables)
    ts = F.col("event_ts").cast("timestamp_ntz").alias("event_ts")
    return found.select("symbol", ts, "order_qty", *PREFERENCES)


# --- outages -----------------------------------------------------------------------------------------

OUTAGES_SQL = """
    WITH RECURSIVE t AS (SELECT event_id, user_id, ts, value,
            CASE WHEN event_type = 'error' THEN 1 + event_id % 7 ELSE 0 END AS d,
            row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
    s AS (SELECT event_id, user_id, rn, value, d AS after, FALSE AS masked FROM t WHERE rn = 1
        UNION ALL
        SELECT t.event_id, t.user_id, t.rn, t.value, CASE WHEN s.after > 0 THEN s.after - 1 ELSE t.d END, s.after > 0
        FROM s JOIN t ON t.user_id = s.user_id AND t.rn = s.rn + 1)
    SELECT event_id, CASE WHEN masked THEN 0 ELSE value END AS value, CASE WHEN after > 0 THEN 'fault' ELSE 'normal' END AS status FROM s"""


def with_trigger(events):
    length = F.when(F.col("event_type") == "error", 1 + F.col("event_id") % 7).cast("int")
    return events.select("event_id", "user_id", "ts", "value", length.alias("trigger"))


@query(OUTAGES_SQL)
def mask_outages(spark, folder):
    rows = with_trigger(table(spark, folder, "events"))
    return outages.mask_outages(rows, "user_id", ["ts"], "trigger", ["value"]).select("event_id", "value", "status")


@query(OUTAGES_SQL)
def mask_outages_long_series(spark, folder):
    """The same with every station long enough to be cut into slices."""
    rows = with_trigger(table(spark, folder, "events"))
    masked = outages.mask_outages(rows, "user_id", ["ts"], "trigger", ["value"], rows_per_slice=40)
    return masked.select("event_id", "value", "status")
