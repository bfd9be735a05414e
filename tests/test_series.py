"""Series operators with one key that holds a large part of the rows, cut into slices."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.draws import key_hash
from tickloom.operators import ordering, outages, parts, series


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows: a third under one key, some under null, the rest spread; times bunched at the end."""
    n = F.col("id")
    key = F.when(n % 3 == 0, "hot").when(n % 50 == 1, None).otherwise(F.concat(F.lit("k"), (n % 40).cast("string")))
    at = F.when(n < 500, n * 1000).otherwise(F.lit(500_000) + n)
    return spark.range(3000).select(
        key.alias("k"), F.timestamp_seconds(at).alias("t"), n.alias("seq"),
        F.when(n % 7 != 0, (n * 37 % 101).cast("double")).alias("v"),
        F.when(n % 11 == 0, n % 5).cast("int").alias("d"),
    ).repartition(5).cache()


def by_time():
    return Window.partitionBy("k").orderBy("t")


SIZES = [20, 300, 10_000]


@pytest.mark.parametrize("rows", SIZES)
def test_running_id(skewed, rows):
    out = series.running_id(skewed, ["k"], ["t"], 7, "r", rows)
    assert out.count() == 3000
    assert out.withColumn("want", F.row_number().over(by_time()) + 7).filter("r <> want").count() == 0


@pytest.mark.parametrize("rows", SIZES)
def test_previous_value(skewed, rows):
    out = series.previous_value(skewed, ["k"], ["t"], "v", "p", rows)
    assert out.withColumn("want", F.lag("v").over(by_time())).filter("NOT (p <=> want)").count() == 0
    two = series.previous_value(skewed, ["k"], ["t", "seq"], "v", "p", rows)
    assert two.withColumn("want", F.lag("v").over(by_time())).filter("NOT (p <=> want)").count() == 0


@pytest.mark.parametrize("rows", SIZES)
@pytest.mark.parametrize("window", [1, 10, 45])
def test_rolling_mean(skewed, rows, window):
    out = series.rolling_mean(skewed, ["k"], ["t"], "v", window, "m", rows)
    last = by_time().rowsBetween(-(window - 1), 0)
    want = F.when(F.count("v").over(last) == window, F.avg("v").over(last)).otherwise(0.0)
    assert out.count() == 3000
    assert out.withColumn("want", want).filter("abs(m - want) > 1e-9 OR m IS NULL").count() == 0


@pytest.mark.parametrize("rows", SIZES)
def test_group_totals_and_weights(skewed, rows):
    group = Window.partitionBy("k")
    out = series.group_totals(skewed, ["k"], {"n": F.count(F.lit(1)), "top": F.max("v")}, rows)
    assert out.count() == 3000
    both = out.withColumn("wn", F.count(F.lit(1)).over(group)).withColumn("wt", F.max("v").over(group))
    assert both.filter("n <> wn OR NOT (top <=> wt)").count() == 0
    weights = series.log_rank_weights(skewed, ["k"], ["seq"], 0.1, "w", rows).filter("k = 'hot'").agg(F.max("w"), F.min("w")).first()
    assert weights[0] == 1.0 and abs(weights[1] - 0.1) < 1e-12
    shares = parts.normalise_weights(skewed.fillna(1.0, ["v"]), ["k"], "v", "s", rows).groupBy("k").agg(F.sum("s").alias("s"))
    assert shares.filter("abs(s - 1) > 1e-9").count() == 0


@pytest.mark.parametrize("rows", SIZES)
def test_random_parts_add_up(skewed, rows):
    weighted = skewed.fillna(1.0, ["v"]).withColumn("total", F.lit(1000))
    out = parts.random_parts(weighted, ["k"], "seq", "total", "v", "p", rows)
    assert out.groupBy("k").agg(F.sum("p").alias("s")).filter("s <> 1000").count() == 0
    assert out.count() == 3000


@pytest.mark.parametrize("order", ["name", "day", "x"])
def test_slices_follow_other_order_types(spark, order):
    rows = spark.range(800).select(
        F.lit("one").alias("k"), F.format_string("n%05d", "id").alias("name"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
        F.when(F.col("id") == 0, None).when(F.col("id") == 799, float("nan")).otherwise(F.col("id") / 3).alias("x"),
    )
    out = series.running_id(rows, ["k"], [order], 0, "r", 50)
    assert out.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy(order))).filter("r <> want").count() == 0


def test_busy_period_is_cut_again(spark):
    """Half of a long key's rows lie in a hundredth of its time."""
    n = F.col("id")
    at = F.when(n < 5000, n * 1_000_000).otherwise(F.lit(2_000_000_000) + n * 10_000)
    rows = spark.range(10_000).select(F.lit("one").alias("k"), F.timestamp_micros(at).alias("t"), "id")
    cut = series.sliced(rows, ["k"], ["t"], 200)
    sizes = [r["count"] for r in cut.rows.groupBy(series.SLICE).count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 200
    out = series.running_id(rows, ["k"], ["t"], 0, "r", 200)
    assert out.withColumn("want", F.row_number().over(by_time())).filter("r <> want").count() == 0


@pytest.mark.parametrize("kind", ["one date", "equal moments", "long prefixes", "nulls"])
def test_slices_of_awkward_orders(spark, kind):
    """Splitters are places in the whole order, so none of these lie in one slice; none is twice the target."""
    n, target = F.col("id"), 2000
    first = {
        "one date": F.lit("2024-01-01").cast("date"), "equal moments": F.timestamp_seconds(n % 3),
        "long prefixes": F.concat(F.lit("the same long prefix "), F.lpad((n * 7919 % 60_013).cast("string"), 6, "0")),
        "nulls": F.when(n % 100 == 0, (n % 7).cast("double")).when(n % 3 == 0, float("nan")),
    }[kind]
    rows = spark.range(60_000).select(F.when(n < 50_000, "long").otherwise("short").alias("k"), first.alias("t"), "id")
    cut = series.sliced(rows, ["k"], ["t", "id"], target)
    sizes = {r[0]: r["count"] for r in cut.rows.filter("k = 'long'").groupBy(series.SLICE).count().collect()}
    assert cut.long is (True) and len(sizes) >= 25 and max(sizes.values()) <= 2 * target and sum(sizes.values()) == 50_000
    out = series.running_id(rows, ["k"], ["t", "id"], 0, "r", target)
    want = F.row_number().over(Window.partitionBy("k").orderBy("t", "id"))
    assert out.withColumn("want", want).filter("r <> want").count() == 0


def test_deltas_beyond_32_bits(spark):
    df = spark.createDataFrame([("A", 1, 0), ("A", 2, 10**14)], "s string, d int, v long")
    assert [r["order_qty"] for r in series.signed_delta(df, ["s"], ["d"], "v").orderBy("d").collect()] == [0, 10**12]


def test_totals_of_equal_rows_do_not_meet_in_a_window(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("k"), F.lit(1).alias("v"))
    out = series.group_totals(rows, ["k"], {"n": F.count(F.lit(1))}, 100)
    assert out.groupBy("n").count().collect() == [(5000, 5000)]
    assert "Window" not in out.filter("k = 'hot'").groupBy("n").count()._jdf.queryExecution().executedPlan().toString().split("Union")[0]


def test_signed_delta_of_the_fixture(spark):
    rows = [("AAPL", f"2024-01-0{i + 1}", 1_000_000 + i * 100_000) for i in range(5)]
    df = spark.createDataFrame(rows, "symbol string, date string, volume long")
    out = series.signed_delta(df, ["symbol"], ["date"], "volume").orderBy("date")
    assert [r["order_qty"] for r in out.collect()] == [0, 1000, 1000, 1000, 1000]
    halves = spark.createDataFrame([("A", 1, 0), ("A", 2, 50), ("A", 3, 200), ("A", 4, None), ("A", 5, 9)], "s string, d int, v long")
    assert [r["order_qty"] for r in series.signed_delta(halves, ["s"], ["d"], "v").orderBy("d").collect()] == [0, 0, 2, 0, 0]


def test_no_rows(spark, skewed):
    none = skewed.filter("seq < 0")
    assert series.rolling_mean(none, ["k"], ["t"], "v").count() == 0
    assert series.running_id(none, ["k"], ["t"]).count() == 0
    assert ordering.positions(none, ["seq"]).count() == 0
    assert outages.mask_outages(none, "k", ["t"], "d", ["v"]).count() == 0


def test_positions_do_not_depend_on_partitions(spark, skewed):
    want = {r["seq"]: r["seq"] for r in skewed.select("seq").collect()}
    for frame, partitions in ((skewed.repartition(1), 3), (skewed.repartition(7), 1), (skewed, 16)):
        out = ordering.positions(frame.select("seq", "v"), ["seq"], partitions=partitions)
        assert {r["seq"]: r["position"] for r in out.collect()} == want
    tied = ordering.positions(skewed.select("seq", F.lit(1).alias("one")), [("one", "desc"), ("seq", "desc")], partitions=4)
    assert tied.filter(F.col("position") != 2999 - F.col("seq")).count() == 0


def test_latest_n_reads_from_the_needed_day(spark):
    rows = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 3600).alias("t"), "id")
    rows = rows.unionByName(spark.range(3).select(F.lit(None).cast("timestamp").alias("t"), "id"))
    for n in (1, 30, 1000):
        out = ordering.latest_n(rows, "t", n, ["id"])
        assert [r["id"] for r in out.collect()] == [999 - i for i in range(n)]
    assert ordering.latest_n(rows, "t", 1002, ["id"]).filter("t IS NULL").count() == 2
    assert ordering.latest_n(rows, "t", 5000, ["id"]).count() == 1003
    assert "cast(t" not in ordering.latest_n(rows, "t", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert [r["id"] for r in ordering.latest_n(rows, "id", 2, ["t"]).collect()] == [999, 998]


@pytest.mark.parametrize("column", ["v", "t", "d"])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_many_first_rows(spark, column, direction):
    n = F.col("id")
    rows = spark.range(60_000).select(
        "id", F.when(n % 97 != 0, F.when(n % 501 == 0, float("nan")).otherwise((n * 7919 % 10_007).cast("double"))).alias("v"),
        F.timestamp_seconds(n % 5000).alias("t"), F.date_add(F.lit("2000-01-01").cast("date"), (n % 300).cast("int")).alias("d"),
    )
    order = [(column, direction), "id"]
    want = [r["id"] for r in ordering.sort_multi(rows, order).limit(2000).collect()]
    assert [r["id"] for r in ordering.head(rows, 2000, order).collect()] == want


def test_large_sample(spark):
    rows = spark.range(50_000)
    want = [r["id"] for r in rows.orderBy(key_hash("id"), "id").limit(2500).collect()]
    narrowed = ordering.sample_n(rows, 2500, "id")
    assert [r["id"] for r in narrowed.collect()] == want
    assert "Filter" in narrowed._jdf.queryExecution().optimizedPlan().toString()
    same = ordering.sample_n(rows.select(F.lit(1).alias("id")), 1500, "id")
    assert same.count() == 1500


def test_equal_parts(spark):
    df = spark.createDataFrame([(1000, 3), (2, 5), (7, 1), (9, 0)], "total long, k int")
    out = parts.equal_parts(df, "total", "k").orderBy("total", "part_no")
    got = {}
    for r in out.collect():
        got.setdefault(r["total"], []).append(r["part"])
    assert got == {1000: [333, 333, 334], 2: [0, 0, 0, 0, 2], 7: [7]}


# --- outages ---------------------------------------------------------------------------------------


def test_outage_golden(spark):
    df = spark.createDataFrame([("s", i, 2 if i == 1 else None, 10.0) for i in range(5)], "station string, frame int, d int, voltage double")
    out = outages.mask_outages(df, "station", ["frame"], "d", ["voltage"]).orderBy("frame").collect()
    assert [r["status"] for r in out] == ["normal", "fault", "fault", "normal", "normal"]
    assert [r["voltage"] for r in out] == [10.0, 10.0, 0.0, 0.0, 10.0]


def step_by_step(durations):
    left, masked, status = 0, [], []
    for d in durations:
        masked.append(left > 0)
        left = left - 1 if left > 0 else d
        status.append("fault" if left > 0 else "normal")
    return masked, status


@pytest.mark.parametrize("rows", [15, 200, 10_000])
def test_outages_of_long_stations(skewed, rows):
    out = outages.mask_outages(skewed, "k", ["t"], "d", ["v"], rows_per_slice=rows)
    series_of = {}
    for r in skewed.orderBy("t").collect():
        series_of.setdefault(r["k"], []).append(r)
    want = {}
    for found in series_of.values():
        masked, status = step_by_step([r["d"] or 0 for r in found])
        want.update({r["seq"]: (0.0 if m else r["v"], s) for r, m, s in zip(found, masked, status)})
    assert {r["seq"]: (r["v"], r["status"]) for r in out.collect()} == want


def test_outages_that_follow_on_one_another(spark):
    """A trigger on every third row: chains of outages as long as the station, and one that hides all others."""
    rng = np.random.default_rng(11)
    rows = [("dense", i, 1 + i % 4 if i % 3 == 0 else None) for i in range(900)] + [("hidden", i, 5000 if i == 3 else 2) for i in range(300)]
    rows += [(None, i, int(rng.integers(1, 6)) if rng.random() < 0.5 else 0) for i in range(400)]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "station string, frame int, d int, voltage double")
    want = {}
    for name in ("dense", "hidden", None):
        mine = [r for r in rows if r[0] == name]
        masked, status = step_by_step([r[2] or 0 for r in mine])
        want.update({r[:2]: (0.0 if m else 1.5, s) for r, m, s in zip(mine, masked, status)})
    for size in (50, 10_000):
        out = outages.mask_outages(df, "station", ["frame"], "d", ["voltage"], rows_per_slice=size)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
        assert {(r["station"], r["frame"]): (r["voltage"], r["status"]) for r in out.collect()} == want
