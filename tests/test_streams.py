"""Streams on small files, run to their end."""

import datetime
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tickloom.operators.outages import mask_outages
from tickloom.plans.view import view
from tickloom.session import list_dir, scratch_path
from tickloom.sources import frames, recent, replay
from tickloom.streaming import live
from tickloom.streaming.outages import mask_outages_stream, open_outages, outage_sink


def source(spark, rows=300, files=6):
    path = scratch_path(spark, "src")
    df = spark.range(rows).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 5).alias("k"))
    df.repartitionByRange(files, "id").write.parquet(path)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query):
    query.awaitTermination()


def test_repeated_batch_replaces_itself(spark):
    path = scratch_path(spark, "live")
    first, second = spark.range(0, 50), spark.range(50, 80)
    live.update_snapshot(first, 0, path, [("id", "desc")], 40)
    live.update_snapshot(second, 1, path, [("id", "desc")], 40)
    live.update_snapshot(second, 1, path, [("id", "desc")], 40)
    assert sorted(r["id"] for r in live.read_snapshot(spark, path).collect()) == list(range(40, 80))
    sink = live.parquet_sink(scratch_path(spark, "sink"))
    for _ in range(2):
        sink(first, 3)


def test_old_versions_go(spark):
    path = scratch_path(spark, "live")
    for i in range(6):
        live.update_snapshot(spark.range(i * 10, i * 10 + 10), i, path, [("id", "desc")], 15, keep=2)
    assert live.snapshot_versions(spark, path) == [4, 5]
    assert sorted(r["id"] for r in live.read_snapshot(spark, path).collect()) == list(range(45, 60))


def test_callback_gets_every_batch(spark):
    df, stream = source(spark)
    seen = []
    finish(live.micro_batch(stream, lambda batch, i: seen.append((i, batch.count())), scratch_path(spark, "p"), None))
    assert [i for i, _ in seen] == list(range(6)) and sum(n for _, n in seen) == 300


def test_polling_picks_up_new_files(spark):
    df, stream = source(spark, 30, 1)
    seen = []
    query = live.micro_batch(stream, lambda batch, i: seen.append(batch.count()), scratch_path(spark, "p"), "100 milliseconds")
    query.processAllAvailable()
    query.stop()
    assert seen == [30]


def test_fan_out_to_two_sinks(spark):
    df, stream = source(spark)
    paths = scratch_path(spark, "a"), scratch_path(spark, "b")
    finish(live.fan_out(stream, [live.parquet_sink(p) for p in paths], scratch_path(spark, "p"), None))
    for p in paths:
        got = spark.read.schema(df.schema).parquet(p + "/batch_id=*")
        assert got.exceptAll(df).count() == 0 and got.count() == 300


def test_live_view_is_the_batch_view_of_the_newest_rows(spark):
    df, stream = source(spark)
    paths = scratch_path(spark, "t"), scratch_path(spark, "v")
    config = {"group_by": ["k"], "columns": ["id", "ts"], "aggregates": {"ts": "last"}}
    finish(live.micro_batch(stream, live.live_view(*paths, config, [("id", "desc")], 120, ["id"]), scratch_path(spark, "p"), None))
    want = view(df.orderBy(F.desc("id")).limit(120), config, ["id"])
    got = live.read_snapshot(spark, paths[1])
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 6


def test_no_late_row_is_lost_in_overlapping_polls(spark):
    path, kept = scratch_path(spark, "polls"), scratch_path(spark, "once")
    ids = spark.range(1000).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    odd = spark.createDataFrame([(None, None), (5000, None)], "id long, ts timestamp")
    twice = ids.unionByName(odd).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(30))))
    # Batches span the whole time; a copy's time differs by less than the delay and may lie on another day.
    polls = twice.select("id", (F.col("ts") + F.make_dt_interval(mins=F.col("copy"))).alias("ts"), (F.xxhash64("id", "copy") % 6).alias("poll"))
    polls.repartition(6, "poll").write.parquet(path)
    stream = spark.readStream.schema(polls.schema).option("maxFilesPerTrigger", 1).parquet(path)
    sink = live.dedupe_overlap(kept, "ts", ["id"], "1 hour")
    seen = []

    def deliver(batch, batch_id):
        for _ in range(2):  # a repeated batch replaces itself
            sink(batch, batch_id)
        seen.append(batch.count())

    finish(live.micro_batch(stream, deliver, scratch_path(spark, "p"), None))
    rows = live.read_days(spark, kept)
    assert len(seen) >= 4 and sum(seen) == 2004
    assert rows.count() == rows.select("id").distinct().count() == 1002


def test_late_rows_are_dropped(spark):
    path = scratch_path(spark, "late")
    spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts")).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("ts timestamp").parquet(path)
    windows = live.event_time_windows(stream, "ts", "10 minutes", [], {"n": F.count(F.lit(1))}, "10 seconds")
    out, progress = scratch_path(spark, "w"), scratch_path(spark, "p")
    finish(live.micro_batch(windows, live.parquet_sink(out), progress, None))
    spark.range(1).select(F.timestamp_seconds(F.lit(30)).alias("ts")).coalesce(1).write.mode("append").parquet(path)
    finish(live.micro_batch(windows, live.parquet_sink(out), progress, None))
    closed = spark.read.schema(windows.schema).parquet(out + "/batch_id=*").orderBy("window_start").collect()
    assert closed and all(r["n"] == 10 for r in closed)


def test_incremental_append(spark):
    path = scratch_path(spark, "store")
    old = spark.createDataFrame([("AAPL", "2024-01-01", 150.0)], "symbol string, date string, open double")
    new = spark.createDataFrame([("AAPL", "2024-01-02", 151.0), ("MSFT", "2024-01-01", 370.0)], "symbol string, date string, open double")
    assert live.incremental_append(old, path, "symbol", ["date"]).count() == 1
    for _ in range(2):
        store = live.incremental_append(new, path, "symbol", ["date"])
        assert sorted((r["symbol"], r["open"]) for r in store.collect()) == [("AAPL", 150.0), ("MSFT", 370.0)]
    assert live.incremental_append(old, path, "symbol", ["date"]).columns == old.columns


def test_numeric_keys_and_new_folders(spark):
    path = scratch_path(spark, "store")
    df = spark.range(20).select((F.col("id") % 4).alias("k"), "id")
    live.incremental_append(df.filter("k < 2"), path, "k", ["id"])
    store = live.incremental_append(df, path, "k", ["id"])
    assert store.exceptAll(df).count() == 0 and store.count() == 20
    # A folder per key, below the load that brought the key.
    folders = [[n for n in list_dir(spark, f"{path}/load={i}") if "=" in n] for i in (0, 1)]
    assert folders == [["k=0", "k=1"], ["k=2", "k=3"]]


def test_retention(spark):
    df = spark.range(10).select(F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.date_format(F.timestamp_seconds(F.col("id") * 86400), "yyyy-MM-dd").alias("day"))
    assert live.expire_old(df, "ts", "3d").count() == 4
    assert live.expire_old(df, "ts").count() == 10
    path = scratch_path(spark, "days")
    df.write.partitionBy("day").parquet(path)
    assert len(live.drop_old_days(spark, path, "1970-01-08")) == 7
    assert spark.read.parquet(path).count() == 3


def test_replay_loops_and_stops(spark):
    df = spark.range(7)
    out = replay.replay_table(df, ["id"], 3, "2024-01-01", "1s", loops=2, end_time="2024-01-01 00:00:04")
    got = sorted((r["frame"], r["id"], str(r["replay_ts"])[-2:]) for r in out.collect())
    assert got == sorted([(i // 3, i % 7, f"0{i // 3}") for i in range(12)])


def test_frames_play_in_order(spark):
    framed = replay.replay_table(spark.range(100), ["id"], 30, "2024-01-01", "1s").drop("replay_ts")
    stored, target = scratch_path(spark, "f"), scratch_path(spark, "pub")
    replay.write_frames(framed, stored, ["id"])
    assert replay.frame_numbers(spark, stored) == [0, 1, 2, 3]
    assert replay.play_frames(spark, stored, target, ["id"]) == 4
    seen = []
    stream = replay.file_replay_source(spark, target, spark.read.parquet(target).schema)
    finish(live.micro_batch(stream, lambda b, i: seen.append(sorted(r["id"] for r in b.collect())), scratch_path(spark, "p"), None))
    assert seen == [list(range(a, min(a + 30, 100))) for a in (0, 30, 60, 90)]


def outage_batches(spark, batches=5):
    """Rows of four stations in several batches, as a stream of one file each; 'quiet' is heard of in the first batch only."""
    path = scratch_path(spark, "outages")
    for b in range(batches):
        rows = [(s, b * 40 + i, (7 if (b * 40 + i) % 11 == 0 else 90 if s == "c" and b == 0 and i == 5 else None), 1.0) for s in "abc" for i in range(40)]
        rows += [("quiet", 39, 200, 1.0)] if b == 0 else []
        spark.createDataFrame(rows, "station string, frame int, d int, v double").coalesce(1).write.mode("append").parquet(path)
    schema = "station string, frame int, d int, v double"
    return spark.read.schema(schema).parquet(path), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_outage_streams_equal_the_batch_form(spark):
    rows, stream = outage_batches(spark)
    want = mask_outages(rows, "station", ["frame"], "d", ["v"])
    path, state = scratch_path(spark, "masked"), scratch_path(spark, "open")
    sink = outage_sink(path, state, "station", ["frame"], "d", ["v"], idle_batches=2, rows_per_slice=15)
    kept = []

    def deliver(batch, batch_id):
        for _ in range(2 if batch_id == 1 else 1):  # a repeated batch replaces itself
            sink(batch, batch_id)
        kept.append({r["station"]: r["left"] for r in open_outages(spark, state).collect()})

    finish(live.micro_batch(stream, deliver, scratch_path(spark, "p"), None))
    got = spark.read.parquet(path + "/batch_id=*").select(want.columns)
    assert len(kept) == 5 and got.exceptAll(want).count() == 0 and got.count() == rows.count()
    assert kept[0]["quiet"] == 200 and "quiet" in kept[1] and "quiet" not in kept[2], "an idle station is forgotten"
    assert all(left > 0 for k in kept for left in k.values())

    masked = mask_outages_stream(stream, "station", ["frame"], "d", ["v"])
    out = scratch_path(spark, "stateful")
    finish(live.micro_batch(masked, live.parquet_sink(out), scratch_path(spark, "p"), None))
    got = spark.read.schema(masked.schema).parquet(out + "/batch_id=*").select(want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == rows.count()


def test_idle_countdowns_expire(spark):
    """A station that is silent for longer than ``idle``, by the time of the others, has no open outage any more."""
    schema = "station string, ts timestamp, d int, v double"
    for idle, want in (("1h", [1.0] * 3), ("5d", [0.0] * 3)):
        path, out, progress = scratch_path(spark, "src"), scratch_path(spark, "out"), scratch_path(spark, "p")
        at = lambda h, m: datetime.datetime(2024, 1, 1, h, m, tzinfo=datetime.timezone.utc)
        rounds = [[("s", at(0, 0), 50, 1.0), ("t", at(0, 0), None, 1.0)], [("t", at(9, 0), None, 1.0)],
                  [("t", at(10, 0), None, 1.0)], [("s", at(10, m), None, 1.0) for m in (1, 2, 3)]]
        for rows in rounds:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        masked = mask_outages_stream(stream, "station", ["ts"], "d", ["v"], ts="ts", idle=idle)
        finish(live.micro_batch(masked, live.parquet_sink(out), progress, None))
        rows = spark.read.schema(masked.schema).parquet(out + "/batch_id=*").filter("station = 's'").orderBy("ts").collect()
        assert [r["v"] for r in rows] == [1.0, *want]


def test_a_broken_load_is_never_seen(spark, monkeypatch):
    path = scratch_path(spark, "store")
    df = spark.createDataFrame([(k, d, k * 10 + d) for k in (1, 2, 3) for d in range(5)], "k int, d int, v int")
    live.incremental_append(df.filter("k = 1"), path, "k", ["d"])

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(live, "put_line", broken)
    for _ in range(2):
        with pytest.raises(RuntimeError):  # all files are there, the list is not
            live.incremental_append(df.filter("k < 3"), path, "k", ["d"])
    assert live.read_loads(spark, path, df.schema).count() == 5
    monkeypatch.undo()
    # A load that broke off between two files left one of its keys' folders.
    half = list_dir(spark, f"{path}/load=1")
    assert "k=2" in half
    df.filter("k = 3 AND d < 2").drop("k").write.mode("overwrite").parquet(f"{path}/load=1/k=3")
    assert live.read_loads(spark, path, df.schema).count() == 5
    store = live.incremental_append(df, path, "k", ["d"])
    assert sorted(map(tuple, store.collect())) == sorted(map(tuple, df.collect()))
    assert live.incremental_append(df, path, "k", ["d"]).count() == 15
    live.merge_loads(spark, path, df.schema, "k", ["d"])
    assert live.listed_loads(spark, path)[1] == [live.listed_loads(spark, path)[0]]
    merged = live.read_loads(spark, path, df.schema)
    assert sorted(map(tuple, merged.select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    for k in (1, 2, 3):
        rows = spark.read.schema("d int, v int").parquet(f"{path}/load={live.listed_loads(spark, path)[0]}/k={k}").collect()
        assert [r["d"] for r in rows] == list(range(5)), "rows of a key are in order"


def test_late_rows_go_to_a_table_of_their_own(spark):
    paths = scratch_path(spark, "windows"), scratch_path(spark, "late")
    sink = live.windows_and_late_rows(*paths, "ts", "10 minutes", ["k"], {"n": ("count", "id"), "top": ("max", "id")}, "10 seconds")
    at = lambda m, s=0: datetime.datetime(2024, 1, 1, 0, m, s, tzinfo=datetime.timezone.utc)
    rounds = [[(1, at(1), "a"), (2, at(12), "a"), (9, None, "a")], [(3, at(5), "a"), (4, at(15), "b")], [(5, at(21), "a")], [(6, at(9, 59), "b"), (7, at(22), "a")]]
    for i, rows in enumerate(rounds):
        batch = spark.createDataFrame(rows, "id int, ts timestamp, k string")
        for _ in range(2 if i == 1 else 1):  # a repeated batch replaces itself
            sink(batch, i)
    closed = spark.read.parquet(paths[0] + "/batch_id=*").orderBy("window_start", "k").collect()
    assert [(r["k"], r["n"], r["top"]) for r in closed] == [("a", 1, 1), ("a", 1, 2), ("b", 1, 4)]
    late = {r["id"]: r["lateness"] for r in spark.read.parquet(paths[1] + "/batch_id=*").collect()}
    assert set(late) == {9, 3, 6} and late[9] is None and late[3] == datetime.timedelta(minutes=6, seconds=50)
    assert [(r["k"], r["n"]) for r in live.open_windows(spark, paths[0]).collect()] == [("a", 2)]


def test_polls_read_on_from_the_mark(spark):
    path, marks = scratch_path(spark, "table"), scratch_path(spark, "marks")
    n = F.col("id")
    rows = spark.range(1000).select("id", F.timestamp_seconds(F.floor(n / 7) * 60).alias("ts"), F.when(n % 2 == 0, n).alias("k"))
    rows.repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(path)
    stored, seen = spark.read.parquet(path), []
    for most in (300, 300, None, None):
        polled = recent.poll_new(stored, "ts", ["k", "id"], marks, most)
        for _ in range(2):  # a poll that breaks off is repeated
            ids = [r["id"] for r in recent.poll_new(stored, "ts", ["k", "id"], marks, most).collect()]
        recent.keep_mark(polled.persist(), "ts", ["k", "id"], marks)
        seen.append(ids)
    assert [len(s) for s in seen] == [300, 300, 400, 0] and sorted(sum(seen, [])) == list(range(1000))
    assert recent.keep_mark(stored.limit(0), "ts", ["k", "id"], marks) is False
    spark.range(1000, 1010).select("id", F.timestamp_seconds(F.floor(n / 7) * 60).alias("ts"), F.lit(None).cast("long").alias("k")).write.mode("append").parquet(path)
    later = recent.poll_new(spark.read.parquet(path), "ts", ["k", "id"], marks)
    assert "GreaterThanOrEqual(ts" in later._jdf.queryExecution().executedPlan().toString()
    assert {r["id"] for r in later.collect()} >= set(range(1001, 1010))


def test_frames_go_on_where_they_stopped(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(k, day + datetime.timedelta(hours=k) if k % 5 else None, Decimal(k) / 4, "clash" if k % 3 else None, [k]) for k in range(70)]
    df = spark.createDataFrame(rows, "id long, at timestamp, price decimal(9,2), batch_id string, many array<long>")
    stored, out, progress = (scratch_path(spark, n) for n in ("frames", "out", "progress"))
    replay.write_frames(replay.replay_table(df, ["id"], 10, "2024-01-01", "1s").drop("replay_ts"), stored, ["id"])
    seen = []

    def sink(batch, number):
        if number == 2 and len(seen) == 2:
            seen.append("lost")
            raise RuntimeError("lost")
        seen.append((number, [r["frame"] for r in batch.select("frame").distinct().collect()]))
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    for turn in range(2):
        query = live.micro_batch(frames.frame_stream(spark, stored), sink, progress, "0 seconds")
        try:
            query.processAllAvailable()
        except StreamingQueryException:
            assert turn == 0
        finally:
            query.stop()
    assert seen == [(0, [0]), (1, [1]), "lost", *[(k, [k]) for k in range(2, 7)]]
    back = spark.read.parquet(f"{out}/*")
    assert back.count() == 70
    assert {tuple(map(str, r)) for r in back.select(*df.columns).collect()} == {tuple(map(str, r)) for r in df.collect()}
    assert {(r["id"] // 10, r["frame"]) for r in back.collect()} == {(k, k) for k in range(7)}
    everything = frames.frame_stream(spark, stored, 0)
    counts = []
    live.micro_batch(everything, lambda b, n: counts.append(b.count()), scratch_path(spark, "p"), None).awaitTermination()
    assert counts == [70]
    none = frames.frame_stream(spark, scratch_path(spark, "nothing"), schema=df.schema)
    live.micro_batch(none, lambda b, n: counts.append(b.count()), scratch_path(spark, "p"), None).awaitTermination()
    assert counts in ([70], [70, 0])
