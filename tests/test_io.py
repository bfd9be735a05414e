"""Files, messages, tables and fills."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import bars, fills, nested, points, stats, tables
from tickloom.session import list_dir, scratch_path, shared_dir
from tickloom.sources import files, messages, recent

DOCUMENT = {"Time Series (Daily)": {
    "2024-01-02": {"1. open": "152.00", "2. high": "157.00", "3. low": "150.00", "4. close": "155.00", "5. volume": "1200000"},
    "2024-01-01": {"1. open": "150.00", "2. high": "155.00", "3. low": "148.00", "4. close": "bad", "5. volume": "x"},
}}


def test_series_document(spark):
    df = spark.createDataFrame([("AAPL", json.dumps(DOCUMENT)), ("NONE", "{}"), ("BAD", "oops")], "symbol string, doc string")
    rows = files.parse_series_document(df, "doc", ["symbol"]).orderBy("date").collect()
    assert [(r["symbol"], str(r["date"]), r["open"], r["close"], r["volume"]) for r in rows] == [
        ("AAPL", "2024-01-01", 150.0, None, 0), ("AAPL", "2024-01-02", 152.0, 155.0, 1_200_000)]


def test_csv_drops_bad_rows_whatever_is_selected(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("ts,ticker,price,shares,day\n2017-01-03 00:02:19,GOOGL,805.5,50,2017-01-03\n"
                "2017-01-03 00:02:20,AAPL,n/a,1,2017-01-03\nbad,AAPL,1.0,1,2017-01-03\n2017-01-03 00:02:21,MSFT,,7,2017-01-04\n"
                "2017-01-03 00:02:22,MSFT,1.5,7.5,2017-01-04\n")
    schema = T.StructType([
        T.StructField("ts", T.TimestampType()), T.StructField("ticker", T.StringType()), T.StructField("price", T.DoubleType()),
        T.StructField("shares", T.LongType()), T.StructField("day", T.DateType()),
    ])
    rows = files.read_csv_typed(spark, str(tmp_path), schema, timestamp_format="yyyy-MM-dd HH:mm:ss", date_format="yyyy-MM-dd")
    assert [r["ticker"] for r in rows.select("ticker").collect()] == ["GOOGL", "MSFT"]
    flagged = files.read_csv_checked(spark, str(tmp_path), schema, timestamp_format="yyyy-MM-dd HH:mm:ss", date_format="yyyy-MM-dd")
    assert flagged.filter("rejected").count() == 3


def test_unknown_file_type(spark):
    with pytest.raises(ValueError):
        files.write_file(spark.range(1), "/tmp/x.feather")


def test_large_key_is_spread_over_files(spark):
    path = scratch_path(spark, "skew")
    df = spark.range(4000).select(F.when(F.col("id") % 4 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("k"), "id")
    # Small ranges are merged at run time, which would hide how a large key is spread.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files.write_by_key(df, path, "k", ["id"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len([n for n in list_dir(spark, path + "/k=hot") if n.endswith(".parquet")]) > 3
    assert spark.read.parquet(path).filter("k = 'hot'").count() == 3000
    for name in list_dir(spark, path + "/k=hot"):
        if name.endswith(".parquet"):
            ids = [r["id"] for r in spark.read.parquet(f"{path}/k=hot/{name}").collect()]
            assert ids == sorted(ids)


def test_partition_pruning(spark):
    path = scratch_path(spark, "slug")
    df = spark.createDataFrame([("Health Care", 1), ("Energy", 2)], "sector string, id int")
    files.write_by_slug(df, path, "sector", ["id"])
    assert [n for n in list_dir(spark, path) if "=" in n] == ["sector_slug=energy", "sector_slug=health_care"]
    plan = spark.read.parquet(path).filter("sector_slug = 'energy'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sector_slug" in plan


def test_table_create_and_append(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.FloatType())])
    path = scratch_path(spark, "tab")
    files.create_table(spark, "trades_t", schema, path)
    files.append_table(spark.createDataFrame([(1.5, 3)], "price double, id int"), "trades_t")
    files.append_table(spark.createDataFrame([(2.5, 1)], "price double, id int"), "trades_t", sort=["id"])
    assert spark.table("trades_t").schema.simpleString() == "struct<id:bigint,price:float>"
    assert spark.table("trades_t").count() == 2
    files.create_table(spark, "trades_t", schema, path)
    assert spark.table("trades_t").count() == 0


def test_messages_round_trip_and_rejects(spark):
    df = spark.createDataFrame([(1, None, 2.5), (2, "x", None)], "id long, tag string, v double")
    text = messages.encode_json(df)
    assert json.loads(text.first()["value"]) == {"id": 1, "tag": None, "v": 2.5}
    more = text.union(spark.createDataFrame([("{oops",), ('{"id": "word"}',), (None,)], "value string"))
    decoded = messages.decode_json(more, df.schema)
    assert sorted(map(tuple, messages.accepted(decoded).collect())) == sorted(map(tuple, df.collect()))
    assert [r["rejected_text"] for r in messages.rejected(decoded).collect()] == ["{oops", '{"id": "word"}', None]


def test_message_arrays(spark):
    df = spark.createDataFrame([(b'[{"id": 1}, {"id": 2}]',), (b"[]",), (b'{"id": 3}',), (b"oops",)], "value binary")
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert sorted(r["id"] for r in messages.decode_json_array(df, schema).collect() if r["id"] is not None) == [1, 2, 3]


def test_console(spark, capsys):
    files.show_batch(spark.range(30), rows=2)
    assert "only showing top 2 rows" in capsys.readouterr().out


def test_recent_slice(spark):
    df = spark.range(100).select(F.timestamp_seconds("id").alias("ts"), "id")
    out = recent.recent_slice(df, "ts", "10s", ["id"], "1970-01-01 00:01:39", [("ts", "desc")], 3)
    assert [r["id"] for r in out.collect()] == [99, 98, 97]


def test_points_round_trip(spark):
    df = spark.createDataFrame([("s1", 0, 1.5, "on"), ("s2", 1, None, "off")], "station string, t int, v double, status string")
    df = df.select("station", F.timestamp_seconds("t").alias("ts"), "v", "status")
    long = points.to_points(df, "grid", "ts", ["station"], ["v", "status"])
    assert long.count() == 3
    wide = points.pivot_fields(long.filter("_value IS NOT NULL"), ["_time", "station"])
    assert [(r["station"], r["v"]) for r in wide.collect()] == [("s1", 1.5)]
    twice = long.withColumn("o", F.lit(1)).unionByName(long.withColumn("o", F.lit(2)).withColumn("_value", F.col("_value") - 1))
    newest = points.pivot_fields(twice, ["_time", "station"], ["v"], order="o")
    assert newest.filter("station = 's1'").first()["v"] == 0.5
    with pytest.raises(ValueError):
        points.field_names(long, limit=1)


def test_point_time_in_a_zone(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.0)], "t string, v double")
    out = points.to_points(df, "m", "t", [], ["v"], zone="+02:00").first()
    assert out["_time_ns"] == 1704060000 * 10**9


def test_bars(spark):
    rows = [("a", 0, 5.0), ("a", 59, 2.0), ("a", 60, 9.0), ("b", 3, None)]
    df = spark.createDataFrame(rows, "k string, s int, p double").select("k", F.timestamp_seconds("s").alias("t"), "p")
    out = bars.resample_bars(df, "t", "p", "1min", ["k"]).orderBy("bar").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in out] == [(5.0, 5.0, 2.0, 2.0, 2), (9.0, 9.0, 9.0, 9.0, 1)]
    with pytest.raises(ValueError):
        bars.resample_bars(df, "t", "p", "2min")


def test_windows_end_and_months(spark):
    df = spark.createDataFrame([("2024-01-31 10:00:00", 2.0), ("2024-01-01 00:00:00", 4.0)], "t string, v double")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = points.aggregate_window(df, "t", "1mo", [], "v", stamp="end").first()
    assert (str(out["t"]), out["v"]) == ("2024-02-01 00:00:00", 3.0)


def test_shares_and_members(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("a", None)], "k string, m int")
    out = stats.value_shares(df, "k", spark.createDataFrame([("a",), ("b",), ("c",)], "k string")).orderBy("k").collect()
    assert [(r["n"], r["percent"]) for r in out] == [(3, 75.0), (1, 25.0), (0, 0.0)]
    assert stats.value_shares(df.limit(0), "k").count() == 0
    assert {r["k"]: r["members"] for r in stats.members_by_group(df, "k", "m").collect()} == {"a": [1], "b": [2]}
    with pytest.raises(ValueError, match="member_rows"):
        stats.members_by_group(spark.range(9).withColumn("k", F.lit(1)), "k", "id", limit=8)


def test_calendar_has_no_gaps(spark):
    df = spark.createDataFrame([("2024-02-28",), ("2024-03-02",), ("2024-03-02",), (None,)], "d string").select(F.col("d").cast("date").alias("d"))
    assert [r["n"] for r in nested.calendar_spine(df, "d").orderBy("day").collect()] == [1, 0, 0, 2]
    assert nested.calendar_spine(df.limit(0), "d").count() == 0


def test_arrays_to_rows(spark):
    df = spark.createDataFrame([("AAPL", [("2024-01-01", "Test event")], ["x", "y"]), ("MSFT", [], [])],
                               "symbol string, events array<struct<date:string,description:string>>, competitors array<string>")
    assert [tuple(r) for r in nested.explode_events(df, ["symbol"], "events").collect()] == [("AAPL", "2024-01-01", "Test event")]
    assert [tuple(r) for r in nested.explode_values(df, ["symbol"], "competitors", "c").collect()] == [("AAPL", "x"), ("AAPL", "y")]


def test_lookup_defaults_and_union(spark):
    df = spark.createDataFrame([("AAPL",), ("ZZZ",), (None,)], "symbol string")
    dim = spark.createDataFrame([("AAPL", "Apple Inc.")], "symbol string, name string")
    out = tables.lookup_join(df, dim, "symbol", {"name": F.concat(F.col("symbol"), F.lit(" Corp."))})
    assert sorted([r["name"] for r in out.collect()], key=str) == ["Apple Inc.", None, "ZZZ Corp."]
    empty = tables.union_tables([], dim.schema, spark)
    assert empty.columns == ["symbol", "name"] and empty.count() == 0
    with pytest.raises(ValueError):
        tables.enforce_schema(df, dim.schema)


def test_lookup_side_is_measured(spark, monkeypatch):
    def hinted(dim):
        return "broadcast" in tables.small_side(dim)._jdf.queryExecution().analyzed().toString().lower()

    df = spark.range(100).select((F.col("id") % 7).alias("k"))
    dim = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert hinted(dim)
    small = tables.lookup_join(df, dim, "k", {"v": -1}).collect()
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 4)
    assert not hinted(dim)
    large = tables.lookup_join(df, dim, "k", {"v": -1})
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small)) and len(small) == 100
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 10)
    assert not hinted(dim)


def test_json_ready(spark):
    df = spark.createDataFrame([(1 << 40, float("inf"), "x")], "n long, v double, t string").withColumn("at", F.timestamp_micros(F.lit(1)))
    assert tuple(tables.json_ready(df).first()) == (float(1 << 40), None, "x", "1970-01-01T00:00:00.000001")


def test_slices_add_up(spark):
    df = spark.range(3000).select("id", (F.col("id") % 97).alias("qty"), (1 + F.col("id") % 10).alias("n"))
    out = fills.order_slices(df, "qty", "n", "id")
    sums = out.groupBy("id", "qty", "n").agg(F.sum("slice_qty").alias("s"), F.min("slice_qty").alias("low"), F.count(F.lit(1)).alias("c"))
    assert sums.filter("s <> qty OR low < 1 OR c <> least(n, qty)").count() == 0
    assert sums.count() == df.filter("qty > 0").count()


def test_fills_of_the_fixture(spark):
    rows = [(f"2024-01-0{i + 1}", "AAPL", 155.0 + i, 148.0 + i, 152.0 + i, 1_000_000 + i * 100_000, "Information Technology") for i in range(5)]
    days = spark.createDataFrame(rows, "date string, symbol string, high double, low double, close double, volume long, sector string")
    desk = fills.Desk(["Ada", "Bo"], ["Cash"], ["XNAS"], ["Growth"], ["S&P 500"])
    rates = [spark.createDataFrame([("Ada", 0.002)], "trader string, rate double"), spark.createDataFrame([], "exec_venue string, rate double")]
    out = fills.fills_from_bars(days, desk, *rates, extras=True).cache()
    assert out.drop("parent_qty", "fill_value").schema.simpleString() == fills.FILLS_SCHEMA.simpleString()
    assert {r["d"]: r["s"] for r in out.groupBy(F.to_date("event_ts").cast("string").alias("d")).agg(F.sum("order_qty").alias("s")).collect()} == {
        f"2024-01-0{d}": 1000 for d in (2, 3, 4, 5)}
    ids = sorted(r["trade_id"] for r in out.collect())
    assert ids == list(range(10_001, 10_001 + len(ids)))
    assert out.filter("order_status = 'FILLED' AND qty <> order_qty").count() == 0
    assert out.filter("qty > order_qty OR bid_price > ask_price OR security_name <> 'AAPL Corp.'").count() == 0
    assert out.filter("side = 'BUY' AND limit_price < price OR side = 'SELL' AND limit_price > price").count() == 0
    again = fills.fills_from_bars(days.repartition(7), desk, *rates, extras=True, rows_per_slice=2)
    assert again.exceptAll(out).count() == 0 and out.exceptAll(again).count() == 0
    none = fills.fills_from_bars(days.limit(1), desk, *rates)
    assert none.count() == 0 and none.columns == fills.FILLS_SCHEMA.names


def test_shared_dir_is_the_session_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
