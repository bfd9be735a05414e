"""The view compiler on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tickloom.plans.view import split_values, view


@pytest.fixture(scope="module")
def ticks(spark):
    rows = [
        ("A", "x", 1.0, 1, "p"), ("A", "x", 3.0, 2, "q"), ("A", "y", 5.0, 3, "q"), ("A", None, 7.0, 4, "p"),
        (None, "x", 9.0, 5, "p"), ("B", "y", None, 6, None), ("B", "y", 2.0, 7, "r"),
    ]
    return spark.createDataFrame(rows, "ticker string, client string, price double, seq long, tag string")


def table(df, *names):
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)


def test_null_key_is_not_the_total(ticks):
    out = view(ticks, {"group_by": ["ticker"], "columns": ["price"]})
    assert table(out, "__level", "ticker", "price") == sorted(
        [(0, None, 27.0), (1, None, 9.0), (1, "A", 16.0), (1, "B", 2.0)], key=repr)


def test_every_aggregate(ticks):
    for how, want in {"mean": 4.0, "avg": 4.0, "max": 7.0, "min": 1.0, "count": 4, "sum": 16.0, "last": 7.0, "dominant": 1.0}.items():
        out = view(ticks, {"group_by": ["ticker"], "columns": ["price"], "aggregates": {"price": how}}, order_by=["seq"])
        assert out.filter("ticker = 'A'").first()["price"] == want, how


def test_last_skips_nulls_and_several_order_columns_agree(ticks):
    config = {"group_by": ["ticker"], "columns": ["tag", "price"], "aggregates": {"tag": "last", "price": "last"}}
    one = view(ticks, config, order_by=["seq"])
    two = view(ticks.withColumn("zero", F.lit(0)), config, order_by=["zero", "seq"])
    want = sorted([(0, None, "r", 2.0), (1, None, "p", 9.0), (1, "A", "p", 7.0), (1, "B", "r", 2.0)], key=repr)
    assert table(one, "__level", "ticker", "tag", "price") == want
    assert table(two, "__level", "ticker", "tag", "price") == want


def test_dominant_ties_give_the_smallest(ticks):
    out = view(ticks, {"group_by": ["ticker"], "columns": ["tag"], "aggregates": {"tag": "dominant"}})
    assert table(out, "__level", "ticker", "tag") == sorted([(0, None, "p"), (1, None, "p"), (1, "A", "p"), (1, "B", "r")], key=repr)


def test_split_columns(ticks):
    out = view(ticks, {"group_by": ["ticker"], "split_by": ["client"], "columns": ["price", "tag"],
                       "aggregates": {"price": "max", "tag": "count"}})
    assert out.columns == ["__level", "ticker", "x|price", "x|tag", "y|price", "y|tag", "null|price", "null|tag"]
    b = out.filter("ticker = 'B'").first()
    assert (b["x|price"], b["x|tag"], b["y|price"], b["y|tag"]) == (None, 0, 2.0, 1)
    total = out.filter("__level = 0").first()
    assert (total["x|price"], total["y|price"], total["null|price"]) == (9.0, 5.0, 7.0)


def test_split_without_group(ticks):
    out = view(ticks, {"split_by": ["client"], "columns": ["price"], "aggregates": {"price": "min"}}, splits=["x", "y"])
    assert [tuple(r) for r in out.collect()] == [(0, 1.0, 2.0)]


def test_too_many_split_values_is_an_error_not_a_cut(spark):
    df = spark.range(50).select((F.col("id") % 20).alias("s"), F.col("id").alias("v"))
    with pytest.raises(ValueError, match="rows"):
        split_values(df, "s", limit=19)
    assert split_values(df, "s", limit=20) == list(range(20))
    assert view(df, {"split_by": ["s"], "columns": ["v"]}, layout="rows").count() == 20


def test_levels_and_names(ticks):
    config = {"group_by": ["ticker", "client"], "columns": ["ticker", "price"], "aggregates": {"ticker": "dominant"}}
    out = view(ticks, config)
    assert out.columns == ["__level", "ticker", "client", "ticker_dominant", "price"]
    assert {r["__level"]: r["count"] for r in out.groupBy("__level").count().collect()} == {0: 1, 1: 3, 2: 5}
    assert view(ticks, config, levels="leaf").count() == 5


def test_sort_and_filter(ticks):
    config = {"group_by": ["ticker"], "columns": ["price"], "filter": [["price", ">", 1], ["ticker", "is not null"]], "sort": [["price", "asc"]]}
    assert [(r["__level"], r["ticker"], r["price"]) for r in view(ticks, config).collect()] == [(0, None, 17.0), (1, "B", 2.0), (1, "A", 15.0)]
    split = view(ticks, {"group_by": ["ticker"], "split_by": ["client"], "columns": ["price"], "sort": [["x|price", "desc"]]})
    assert [r["ticker"] for r in split.collect()] == [None, None, "A", "B"]


def test_plain_view_keeps_rows(ticks):
    config = {"columns": ["twice", None, "seq"], "expressions": {"twice": "price * 2"}, "sort": [["seq", "desc"]], "filter": [["tag", "begins with", "q"]]}
    assert [tuple(r) for r in view(ticks, config).collect()] == [(10.0, 3), (6.0, 2)]


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 3)], "`Sub-Category` string, `a.b` int, `Customer ID` int")
    out = view(df, {"group_by": ["Sub-Category"], "split_by": ["a.b"], "columns": ["Customer ID"]})
    assert out.columns == ["__level", "Sub-Category", "1|Customer ID"]
    assert out.filter("__level = 1").first()["1|Customer ID"] == 5


@pytest.mark.parametrize("config, message", [
    ({"group_by": ["nope"]}, "nope"),
    ({"group_by": ["ticker"], "columns": ["price"], "aggregates": {"price": "median"}}, "median"),
    ({"group_by": ["ticker"], "columns": ["price"], "aggregates": {"price": "last"}}, "order_by"),
    ({"groupby": ["ticker"]}, "groupby"),
    ({"columns": ["price"], "filter": [["price", "~", 1]]}, "~"),
    ({"group_by": ["ticker"], "columns": ["price"], "sort": [["price", "up"]]}, "up"),
])
def test_bad_configs(ticks, config, message):
    with pytest.raises(ValueError, match=message):
        view(ticks, config)


def test_raw_rows_are_not_multiplied(ticks):
    """Levels are made from the aggregated groups, after the first exchange."""
    plan = view(ticks, {"group_by": ["ticker", "client"], "columns": ["price"]})._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning(__k0")
    assert "SortAggregate" not in plan


def test_partitions_do_not_matter(ticks):
    config = {"group_by": ["ticker"], "split_by": ["client"], "columns": ["price", "tag", "client"],
              "aggregates": {"price": "last", "tag": "dominant", "client": "count"}, "sort": [["x|price", "asc"]]}
    want = [tuple(r) for r in view(ticks, config, ["seq"]).collect()]
    for n in (1, 7):
        assert [tuple(r) for r in view(ticks.repartition(n), config, ["seq"]).collect()] == want
