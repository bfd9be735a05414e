"""A view kept from parts, against the view computed from the live rows after every batch."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators.ordering import sort_multi
from tickloom.plans.view import view
from tickloom.session import scratch_path
from tickloom.streaming.live import read_snapshot
from tickloom.streaming.maintained import BUCKET, MaintainedView, maintained_view

CONFIG = {
    "group_by": ["zone", "station"], "columns": ["price", "cents", "exact", "low", "n", "at", "tag", "mode"],
    "aggregates": {"price": "mean", "cents": "sum", "exact": "sum", "low": "min", "n": "max", "at": "last", "tag": "last", "mode": "dominant"},
}


def rows_of(spark, first, count, stations=9):
    n = F.col("id")
    return spark.range(first, first + count).select(
        F.col("id"), F.when(n % stations == 4, None).otherwise((n % stations % 3).cast("string")).alias("zone"),
        F.concat(F.lit("s"), (n % stations).cast("string")).alias("station"),
        ((n * 7919 % 1000) / 10).alias("price"), F.when(n % 5 > 1, n % 13).alias("cents"), (n % 17).cast("decimal(12,2)").alias("exact"),
        (n * 31 % 50).cast("int").alias("low"), (n * 17 % 97).cast("int").alias("n"), F.timestamp_seconds(n * 60).alias("at"),
        F.when(n % 4 != 0, F.concat(F.lit("t"), (n % 6).cast("string"))).alias("tag"), (n * n % 4).alias("mode"),
    )


def same_rows(a, b):
    def plain(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)
    assert a.columns == b.columns and plain(a) == plain(b)


@pytest.mark.parametrize("split", [False, True])
def test_view_after_every_batch(spark, split):
    config = {**CONFIG, "group_by": ["zone"], "split_by": ["station"]} if split else {**CONFIG, "filter": [["price", ">", 5]]}
    order, limit = [("at", "desc")], 400
    path, shown = scratch_path(spark, "kept"), scratch_path(spark, "shown")
    sink = maintained_view(path, shown, config, order, limit, ["at"], buckets=16)
    # In order, overlapping in time, older than all, more than the limit at once, and none.
    batches = [rows_of(spark, 0, 150), rows_of(spark, 300, 200), rows_of(spark, 150, 150), rows_of(spark, 600, 900), rows_of(spark, 10, 20), rows_of(spark, 0, 0)]
    batches = batches[1:4] if split else batches
    seen = None
    for i, batch in enumerate(batches):
        for _ in range(2 if i == 2 else 1):  # a repeated batch replaces itself
            sink(batch, i)
        seen = batch if seen is None else seen.unionByName(batch)
        live = sort_multi(seen, order).limit(limit)
        same_rows(read_snapshot(spark, shown), view(live, config, ["at"]))
    kept = MaintainedView(path, config, order, limit, ["at"], 16)
    same_rows(kept.table(spark, batches[0].schema), live)


def test_a_batch_reads_raw_rows_of_touched_groups_only(spark, monkeypatch):
    """Two groups send rows and lose rows; the others' raw rows are not read."""
    config = {"group_by": ["station"], "columns": ["price", "n"], "aggregates": {"price": "mean", "n": "max"}}
    path = scratch_path(spark, "kept")
    kept = MaintainedView(path, config, [("at", "desc")], 900, ["at"], 4096)
    read = []
    real = MaintainedView.raw_rows

    def counted(self, *given):
        rows = real(self, *given)
        read.extend((r["station"], r["count"]) for r in rows.groupBy("station").count().collect())
        # Nothing but the wanted folders is scanned.
        assert {f.split("/bucket=")[1].split("/")[0] for f in rows.inputFiles()} <= {str(b) for b in given[3]}
        return rows

    monkeypatch.setattr(MaintainedView, "raw_rows", counted)
    old = rows_of(spark, 0, 300).filter("station IN ('s1', 's2')")
    kept.update(old, 0)
    kept.update(rows_of(spark, 300, 900 - old.count()).filter("station NOT IN ('s1', 's2')"), 1)
    assert read == []
    kept.update(rows_of(spark, 5000, 260).filter("station = 's1'").limit(20), 2)
    assert read == []
    kept.update(rows_of(spark, 6000, 3000).filter("station = 's2'").limit(220), 3)
    assert read and {s for s, _ in read} <= {"s1", "s2"} and sum(n for _, n in read) < 900
    monkeypatch.undo()  # the whole table is read only to compare
    schema = old.schema
    same_rows(kept.view(spark, schema), view(kept.table(spark, schema), config, ["at"]))
    assert kept.table(spark, schema).count() == 900


def test_integers_and_extremes_are_taken_back_without_raw_rows(spark, monkeypatch):
    """Sums of integers shrink by subtraction; a group is computed anew only where its extreme left."""
    config = {"group_by": ["station"], "columns": ["cents", "n"], "aggregates": {"cents": "sum", "n": "max"}}
    kept = MaintainedView(scratch_path(spark, "kept"), config, [("id", "desc")], 6, ["id"], 8)
    anew = []
    real = MaintainedView._anew

    def counted(self, spark, schema, plan, again, state):
        anew.append(sorted(r["__k0"] for r in again.collect()))
        return real(self, spark, schema, plan, again, state)

    monkeypatch.setattr(MaintainedView, "_anew", counted)
    schema = "id long, station string, cents long, n int"
    kept.update(spark.createDataFrame([(1, "a", 5, 1), (2, "b", 7, 9), (3, "a", 2, 4), (4, "b", 1, 2), (5, "a", None, 3), (6, "b", 3, 1)], schema), 0)
    kept.update(spark.createDataFrame([(7, "a", 1, 1), (8, "b", 1, 1)], schema), 1)
    assert anew == [["b"]]
    found = {r["station"]: (r["cents"], r["n"]) for r in kept.view(spark, spark.createDataFrame([], schema).schema).collect()}
    assert found == {None: (8, 4), "a": (3, 4), "b": (5, 2)}
    kept.update(spark.createDataFrame([(k, "c", 1, 1) for k in range(10, 16)], schema), 2)
    found = {r["station"]: (r["cents"], r["n"]) for r in kept.view(spark, spark.createDataFrame([], schema).schema).collect()}
    assert found == {None: (6, 1), "c": (6, 1)}


def test_bucket_column_is_not_shown(spark):
    kept = MaintainedView(scratch_path(spark, "kept"), {"group_by": ["station"], "columns": ["n"]}, [("at", "desc")], 50)
    kept.update(rows_of(spark, 0, 80), 0)
    schema = rows_of(spark, 0, 1).schema
    assert BUCKET not in kept.view(spark, schema).columns and kept.table(spark, schema).columns == schema.names
