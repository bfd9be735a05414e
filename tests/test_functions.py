"""Column functions on hand-made values."""

from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickloom.functions import draws, scalars, spans
from tickloom.operators import filters


def values(df, name):
    return [r[name] for r in df.collect()]


def test_numbers_from_text(spark):
    texts = ["150.004", " 7 ", "1e3", "n/a", "", None, "12d", "-.5", "0.125", "0x10"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(df.select(scalars.to_numeric_coerce("t").alias("v")), "v") == [
        150.0, 7.0, 1000.0, None, None, None, None, -0.5, 0.12, None]
    assert values(df.select(scalars.to_int_fill("t").alias("v")), "v") == [150, 7, 1000, 0, 0, 0, 0, 0, 0, 0]


def test_large_whole_number_is_exact(spark):
    df = spark.createDataFrame([("9007199254740993",)], "t string")
    assert values(df.select(scalars.to_int_fill("t").alias("v")), "v") == [9007199254740993]


def test_non_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (1.5,), (None,)], "v double")
    assert values(df.select(scalars.null_non_finite("v").alias("v")), "v") == [None, None, None, 1.5, None]


def test_parse_timestamps(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05.25 +0000",), ("2024-01-02 03:04:05 +0100",), (None,)], "t string")
    assert values(df.select(scalars.parse_timestamps("t").cast("string").alias("v")), "v") == [
        "2024-01-02 03:04:05.25", "2024-01-02 02:04:05", None]
    bad = spark.createDataFrame([("yesterday",)], "t string")
    with pytest.raises(PySparkException):
        bad.select(scalars.parse_timestamps("t").alias("v")).collect()
    assert values(bad.select(scalars.parse_timestamps("t", on_error="null").alias("v")), "v") == [None]


def test_local_to_utc_follows_daylight_saving(spark):
    df = spark.createDataFrame([("2024-01-15 12:00:00",), ("2024-07-15 12:00:00",)], "t string")
    out = df.select(scalars.local_to_utc(F.col("t").cast("timestamp"), "America/New_York").cast("string").alias("v"))
    assert values(out, "v") == ["2024-01-15 17:00:00", "2024-07-15 16:00:00"]


def test_epoch_before_1970(spark):
    df = spark.createDataFrame([(-1,), (1483401739000000999,)], "n bigint")
    assert values(df.select(scalars.from_epoch_ns("n").cast("string").alias("v")), "v") == [
        "1969-12-31 23:59:59.999999", "2017-01-03 00:02:19"]


def test_bucket(spark):
    df = spark.createDataFrame([("1969-12-31 23:59:30",), ("2024-02-29 10:07:08.5",)], "t string")
    ts = F.col("t").cast("timestamp")
    for span, want in {
        "1m": ["1969-12-31 23:59:00", "2024-02-29 10:07:00"], "1h": ["1969-12-31 23:00:00", "2024-02-29 10:00:00"],
        "1w": ["1969-12-29 00:00:00", "2024-02-26 00:00:00"], "1y": ["1969-01-01 00:00:00", "2024-01-01 00:00:00"],
        "6mo": ["1969-07-01 00:00:00", "2024-01-01 00:00:00"],
    }.items():
        assert values(df.select(scalars.bucket(ts, span).cast("string").alias("v")), "v") == want
    with pytest.raises(ValueError):
        scalars.bucket(ts, "1mo2d")


def test_spans():
    assert spans.parse_span("-7d") == (0, -7 * 86_400_000_000)
    assert spans.parse_span("1h30m") == (0, 5_400_000_000)
    assert spans.parse_span("1y6mo") == (18, 0)
    assert spans.parse_span("250 milliseconds") == (0, 250_000)
    assert spans.parse_span("1 minute") == (0, 60_000_000)
    for bad in ("", "x", "7", "d7", "1q"):
        with pytest.raises(ValueError):
            spans.parse_span(bad)


def test_draws_are_fixed_and_even(spark):
    df = spark.createDataFrame([("a",)], "k string")
    assert values(df.select(draws.key_hash("k").alias("v")), "v") == [214005177]
    many = spark.range(20_000)
    shares = many.select(draws.weighted_choice(["x", "y", "z"], [1, 0, 3], draws.key_unit("id", 5)).alias("c"))
    counted = {r["c"]: r["count"] for r in shares.groupBy("c").count().collect()}
    assert set(counted) == {"x", "z"} and abs(counted["x"] - 5000) < 300


def test_weighted_choice_checks_its_weights():
    with pytest.raises(ValueError):
        draws.weighted_choice(["a"], [0], F.lit(0.5))
    with pytest.raises(ValueError):
        draws.weighted_choice(["a", "b"], [1], F.lit(0.5))


def test_pick_from_empty_array_is_null(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, ["x"])], "k int, a array<string>")
    assert values(df.select(draws.pick_from_array("a", "k").alias("v")), "v") == [None, None, "x"]


def test_weights_in_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [0.0, 1.0, 3.0], u) for u in (0.0, 0.2, 0.25, 0.99)],
                               "c array<string>, w array<double>, u double")
    assert values(df.select(draws.weighted_from_arrays("c", "w", F.col("u")).alias("v")), "v") == ["b", "b", "c", "c"]


def test_session_time_stays_inside(spark):
    days = spark.range(5000).select("id", F.lit(date(2024, 1, 2)).alias("day"))
    ends = days.select(scalars.session_timestamp("day", draws.key_hash("id")).alias("t")).agg(
        F.min("t").cast("string").alias("a"), F.max("t").cast("string").alias("b")).first()
    assert ends["a"] >= "2024-01-02 09:30:00" and ends["b"] <= "2024-01-02 16:00:00"


def test_prices_and_power(spark):
    df = spark.createDataFrame([("BUY", 9.0, 11.0, 0.5, 0.0), ("SELL", 9.0, 11.0, 0.5, 4.0)],
                               "side string, bid double, ask double, slip double, volt double")
    out = df.select(scalars.fill_price("side", "bid", "ask", "slip").alias("p"), scalars.mid("bid", "ask").alias("m"),
                    scalars.spread("bid", "ask").alias("s"), scalars.current("bid", "volt").alias("c"))
    assert [tuple(r) for r in out.collect()] == [(11.5, 10.0, 2.0, None), (8.5, 10.0, 2.0, 2.25)]


def test_time_filters(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d, 12),) for d in range(1, 11)], "t timestamp_ntz")
    as_of = "2024-01-10 12:00:00"
    kept = filters.range_filter(df, "t", "-2d", "-1d", as_of)
    assert [r["t"].day for r in kept.collect()] == [8]
    assert [r["t"].day for r in filters.range_filter(df, "t", "-2d", None, as_of).collect()] == [8, 9, 10]
    assert filters.time_span_filter(df, "t", "2d", as_of).count() == 3
    assert filters.time_span_filter(df, "t", "-2d", as_of).count() == 3
    assert filters.time_span_filter(df, "t", "whenever", as_of).count() == 10
    assert filters.time_span_filter(df, "t", None, as_of).count() == 10


def test_filter_reaches_the_scan(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    kept = filters.range_filter(events, "ts", "-7d", as_of="2024-01-20").select("value")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_missing_column():
    class Frame:
        columns = ["a"]

    with pytest.raises(ValueError, match="b, c"):
        filters.require_columns(Frame, ["a", "b", "c"])


def test_provider_errors(spark):
    texts = ['{"Information": "our rate limit is 5, premium has more"}', '{"Error": "bad key"}', "timestamp,open\n2024-01-01,1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    good, bad = filters.reject_error_payloads(df, "t")
    assert values(good, "t") == texts[2:]
    assert values(bad, "reason") == ["rate limit", "error"]
