"""Rows that must not get lost, change or fail."""

import decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import filters, outages, parts, points, series, stats
from tickloom.operators.tables import lookup_join
from tickloom.plans.view import view
from tickloom.sources import files, messages


def test_csv_of_another_program(spark, tmp_path):
    frame = pd.DataFrame({"id": [1, 2, 3, 4], "text": ['x "q", y', "line1\nline2", " sp ", "a\r\nb"]})
    frame.to_csv(tmp_path / "a.csv", index=False)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    rows = files.read_csv_typed(spark, str(tmp_path / "a.csv"), schema).collect()
    assert sorted((r["id"], r["text"]) for r in rows) == sorted(zip(frame["id"].tolist(), frame["text"]))


def test_rows_with_too_few_or_many_cells_are_flagged(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,a\n2\n3,c,d\nx,e\n5,f\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    rows = files.read_csv_checked(spark, str(tmp_path / "a.csv"), schema).collect()
    assert len(rows) == 5 and sum(r["rejected"] for r in rows) == 3
    assert sorted(r["id"] for r in files.read_csv_typed(spark, str(tmp_path / "a.csv"), schema).collect()) == [1, 5]


def test_array_messages_that_do_not_fit_are_rejected(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
    texts = ['[{"id": 1, "v": 2.5}, {"id": 2}]', '{"id": 3, "v": 1}', '[{"id": 4}, {"id": "x"}]', "[{broken", "[]", None]
    rows = messages.decode_json_array(spark.createDataFrame([(t,) for t in texts], "value string"), schema)
    assert sorted(r["id"] for r in messages.accepted(rows).collect()) == [1, 2, 3]
    assert sorted(r["rejected_text"] or "" for r in messages.rejected(rows).collect()) == ["", texts[2], texts[3]]


def test_shares_of_null_and_unlisted_values(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,), ("z",)], "v string")
    listed = spark.createDataFrame([("a",), ("a",), (None,), ("q",)], "v string")
    found = {r["v"]: (r["n"], r["percent"]) for r in stats.value_shares(rows, "v", listed).collect()}
    assert found == {"a": (1, 25.0), "b": (1, 25.0), None: (1, 25.0), "z": (1, 25.0), "q": (0, 0.0)}


def test_previous_value_with_a_null_order_value(spark):
    rows = spark.createDataFrame([("k", None, 100)] + [("k", i, i) for i in range(40)], "k string, t int, v int")
    answers = []
    for size in (5, 1000, None):
        found = series.previous_value(rows, ["k"], ["t"], "v", rows_per_slice=size).collect()
        answers.append({r["t"]: r["previous"] for r in found})
    assert answers[0] == answers[1] == answers[2] and answers[0][0] == 100


def test_parts_of_weights_that_add_up_to_nothing(spark):
    rows = [("a", 1, 10, 0.0), ("a", 2, 10, 0.0), ("b", 1, 10, None), ("b", 2, 10, 1.0), ("c", 1, 10, None)]
    found = parts.random_parts(spark.createDataFrame(rows, "k string, o int, total long, w double"), ["k"], "o", "total", "w").collect()
    assert {(r["k"], r["o"]): r["part"] for r in found} == {("a", 1): 0, ("a", 2): 10, ("b", 1): 0, ("b", 2): 10, ("c", 1): 10}


def test_error_messages_are_rejected(spark):
    rows = spark.createDataFrame([('{"Error Message": "bad call"}',), ('{"Error": "x"}',), ('{"Erro": "x"}',), ('{"Meta": 1}',)], "t string")
    good, bad = filters.reject_error_payloads(rows, "t")
    assert good.count() == 2 and {r["reason"] for r in bad.collect()} == {"error"}


def test_only_files_with_breaks_in_cells_are_read_in_one_piece(spark, tmp_path):
    schema = "id int, t string"
    for name, text, whole in (("plain", 'id,t\n1,"a ""b"" c"\n2,\n', False), ("broken", 'id,t\n1,"a\nb"\n2,x\n', True), ("stray", 'id,t\n1,5" pipe\n2,x\n', True)):
        path = str(tmp_path / f"{name}.csv")
        (tmp_path / f"{name}.csv").write_text(text)
        assert files.quoted_breaks(spark, path) is whole
        assert sorted(r["id"] for r in files.read_csv_typed(spark, path, T.StructType.fromDDL(schema)).collect()) == [1, 2]
    assert files.quoted_breaks(spark, str(tmp_path / "plain.csv"), "UTF-16")


def test_view_names_stay_apart(spark):
    rows = spark.createDataFrame([("x", "null", 1, 1), ("x", None, 2, 1), ("y", "b", 3, 1)], "ticker string, side string, v int, ticker_count int")
    split = view(rows, {"group_by": ["ticker"], "split_by": ["side"], "columns": ["v"], "aggregates": {"v": "sum"}})
    assert len(set(split.columns)) == len(split.columns) and split.count() == 3
    both = view(rows, {"group_by": ["ticker"], "columns": ["ticker", "ticker_count"], "aggregates": {"ticker": "count"}})
    assert len(set(both.columns)) == len(both.columns) and both.count() == 3


def test_decimal_readings_are_blanked(spark):
    rows = [("s", i, 1 if i == 0 else None, decimal.Decimal("1.50")) for i in range(3)]
    df = spark.createDataFrame(rows, "station string, t int, d int, v decimal(18,2)")
    out = outages.mask_outages(df, "station", ["t"], "d", ["v"])
    assert out.schema["v"] == df.schema["v"]
    assert [r["v"] for r in out.orderBy("t").collect()] == [decimal.Decimal(x) for x in ("1.50", "0.00", "1.50")]


def test_points_come_back_as_they_were(spark):
    rows = [(1, "a", 5, 1.5), (2, None, 7, None), (3, "", None, 2.0)]
    df = spark.createDataFrame(rows, "t int, name string, n long, v double").withColumn("at", F.timestamp_seconds("t"))
    long = points.to_points(df, "m", "at", [], ["name", "n", "v"], extra=["t"])
    typed = points.pivot_fields(long, ["t"], {"name": "string", "n": "bigint", "v": "double"})
    assert sorted(map(tuple, typed.collect())) == rows
    found = points.pivot_fields(long.withColumn("o", F.lit(1)), ["t"], order="o").select("t", "name", "n", "v")
    assert sorted(map(tuple, found.collect())) == rows
    with pytest.raises(ValueError):
        points.pivot_fields(long, ["t"], limit=2)


def test_lookup_with_repeated_keys_does_not_multiply_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, k string")
    dim = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", None), (None, "n")], "k string, v string")
    found = lookup_join(df, dim, "k", {"v": "none"}).orderBy("id").collect()
    assert [(r["id"], r["v"]) for r in found] == [(1, "x"), (2, "none"), (3, "none"), (4, "none")]
