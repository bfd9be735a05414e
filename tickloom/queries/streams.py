"""Queries that run a stream over the driver's events to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.filters import filter_eq
from tickloom.queries.batch import OUTAGES_SQL, with_trigger
from tickloom.queries.registry import mean_sql, money, query, table, view_sql
from tickloom.queries.views import as_doubles
from tickloom.session import scratch_path
from tickloom.sources import frames, recent, replay
from tickloom.streaming import live
from tickloom.streaming.maintained import maintained_view
from tickloom.streaming.outages import mask_outages_stream, outage_sink


def event_stream(spark, folder):
    """The events table as a stream, read where it lies."""
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def event_files(spark, folder, files=6):
    """The events in several files, in time ranges, so that a stream over them has several batches."""
    path = scratch_path(spark, "event-files")
    table(spark, folder, "events").repartitionByRange(files, "ts").write.parquet(path)
    return path


def batches(spark, path, schema, files_per_batch=2):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(stream, sink, output_mode="append"):
    """Read what is there, hand it to the sink and stop."""
    spark = stream.sparkSession
    live.micro_batch(stream, sink, scratch_path(spark, "progress"), None, output_mode).awaitTermination()


def collected(stream, output_mode="append"):
    """The stream's rows, batch by batch, as a table."""
    path = scratch_path(stream.sparkSession, "out")
    run(stream, live.parquet_sink(path), output_mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(path + "/batch_id=*")


@query("SELECT event_id, ts, event_type, value FROM events")
def micro_batch(spark, folder):
    return collected(event_stream(spark, folder).select("event_id", "ts", "event_type", "value"))


@query("""
    SELECT 'first' AS sink, event_id, value FROM events
    UNION ALL SELECT 'second', event_id, value FROM events WHERE event_type = 'click'""")
def fan_out(spark, folder):
    """One sink keeps every row, the other one kind of event."""
    paths = [scratch_path(spark, "first"), scratch_path(spark, "second")]
    keep_all, keep_clicks = live.parquet_sink(paths[0]), live.parquet_sink(paths[1])
    sinks = [keep_all, lambda batch, batch_id: keep_clicks(filter_eq(batch, {"event_type": "click"}), batch_id)]
    source = event_files(spark, folder)
    stream = batches(spark, source, table(spark, folder, "events").schema)
    started = live.fan_out(stream, sinks, scratch_path(spark, "progress"), None)
    started.awaitTermination()
    outputs = [
        spark.read.schema(stream.schema).parquet(path + "/batch_id=*").select(F.lit(name).alias("sink"), "event_id", "value")
        for name, path in zip(("first", "second"), paths)
    ]
    return outputs[0].unionByName(outputs[1])


@query("SELECT event_id, ts, event_type, value FROM events ORDER BY ts DESC LIMIT 2500")
def bounded_table(spark, folder):
    path = scratch_path(spark, "live")
    stream = batches(spark, event_files(spark, folder), table(spark, folder, "events").schema)
    run(stream, live.bounded_table(path, [("ts", "desc")], 2500))
    return live.read_snapshot(spark, path).select("event_id", "ts", "event_type", "value")


@query("SELECT event_id, ts, value FROM events")
def dedupe_overlap(spark, folder):
    """Every event arrives again, often in a later one of six batches that all span the whole time, and is kept once."""
    def polled(events):
        late = F.explode(F.array(F.lit(0), F.lit(30)))
        twice = events.select("event_id", "ts", "value", late.alias("minutes"))
        return twice.withColumn("turn", F.xxhash64("event_id", "minutes"))

    stream = played_events(spark, folder, polled, frames=6, order=["turn", "event_id", "minutes"])
    path = scratch_path(spark, "once")
    run(stream, live.dedupe_overlap(path, "ts", ["event_id"], "1 hour"))
    return live.read_days(spark, path).select("event_id", "ts", "value")


@query(view_sql(
    """SELECT event_type, value::DECIMAL(18,2) AS price, ts FROM events
       WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""", ["event_type"],
    {"value": mean_sql("price"), "ts": "max(ts) {f}"},
))
def rolling_view(spark, folder):
    """The stream is stored by day; the view reads the folders of its last day."""
    path = scratch_path(spark, "days")
    stream = batches(spark, event_files(spark, folder), table(spark, folder, "events").schema).withColumn("value", money("value"))
    run(stream, live.day_sink(path, "ts"))
    config = {"group_by": ["event_type"], "columns": ["value", "ts"], "aggregates": {"value": "mean", "ts": "last"}}
    return live.rolling_view(live.read_days(spark, path), "ts", "1d", config, ["ts"], day="day")


@query("""
    SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, max(value) AS high FROM (
        SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i) AS w FROM events, generate_series(0, 3) AS g(i)) GROUP BY ALL""")
def sliding_windows(spark, folder):
    windows = live.event_time_windows(
        table(spark, folder, "events"), "ts", "1 day", ["event_type"],
        {"n": F.count(F.lit(1)), "high": F.max("value")}, slide="6 hours",
    )
    return _plain_windows(windows)


def _plain_windows(windows):
    return windows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
        event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL""")
def event_time_windows(spark, folder):
    """Batches come in time order and a row a day after the last event closes its windows; that row's own stays open."""
    def closed(events):
        kept = events.select("event_id", "ts", "event_type", "value")
        last = kept.agg(F.max("ts").alias("ts")).filter("ts IS NOT NULL")
        closing = last.select((F.col("ts") + F.make_dt_interval(days=F.lit(1))).alias("ts"))
        return kept.unionByName(closing, allowMissingColumns=True)

    stream = played_events(spark, folder, closed)
    windows = live.event_time_windows(
        stream, "ts", "1 hour", ["event_type"], {"n": F.count(F.lit(1)), "total": F.sum(money("value"))}, "10 seconds"
    )
    return as_doubles(_plain_windows(collected(windows)))


REPLAY_CHUNK = 1000


@query(f"""
    WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events),
    r AS (SELECT event_id, p + l * n AS p FROM p, generate_series(0, 1) AS g(l))
    SELECT event_id, p // {REPLAY_CHUNK} AS frame,
        TIMESTAMP '2024-06-01' + to_milliseconds(250 * (p // {REPLAY_CHUNK})) AS replay_ts FROM r""")
def replay_table(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts")
    framed = replay.replay_table(events, ["ts", "event_id"], REPLAY_CHUNK, "2024-06-01", "250ms", loops=2)
    return framed.select("event_id", "frame", F.col("replay_ts").cast("timestamp_ntz").alias("replay_ts"))


@query(f"""
    WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM events)
    SELECT event_id, p // {REPLAY_CHUNK} AS frame FROM p WHERE p // {REPLAY_CHUNK} < 4""")
def stop_at(spark, folder):
    """Frames are a second apart, so the fifth second and what follows is cut off."""
    events = table(spark, folder, "events").select("event_id", "ts")
    framed = replay.replay_table(events, ["ts", "event_id"], REPLAY_CHUNK, "2024-06-01", "1s", end_time="2024-06-01 00:00:04")
    return framed.select("event_id", "frame")


def played_events(spark, folder, columns, frames=5, files=4, order=("ts", "event_id")):
    """The events published frame by frame, and the stream that reads them one frame per batch.

    A frame is a fixed part of the table, whatever its size, and so several files.
    """
    events = columns(table(spark, folder, "events"))
    chunk = -(-events.count() // frames)
    framed = replay.replay_table(events, order, chunk, "2024-06-01", "250ms").drop("replay_ts")
    stored, target = scratch_path(spark, "frames"), scratch_path(spark, "published")
    replay.write_frames(framed, stored, order)
    replay.play_frames(spark, stored, target, order, files=files)
    return replay.file_replay_source(spark, target, spark.read.parquet(target).schema, files)


@query("""
    WITH p AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events)
    SELECT event_id, value, p // ((n + 4) // 5) AS frame, p // ((n + 4) // 5) AS batch_id FROM p""")
def file_replay_source(spark, folder):
    """Every row arrives once, and in batch i comes frame i."""
    stream = played_events(spark, folder, lambda e: e.select("event_id", "ts", "value"))
    path = scratch_path(spark, "out")
    run(stream, live.parquet_sink(path))
    rows = spark.read.option("basePath", path).parquet(path + "/batch_id=*")
    return rows.select("event_id", "value", F.col("frame").cast("bigint"), F.col("batch_id").cast("bigint"))


@query("""
    WITH p AS (SELECT event_id, ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events)
    SELECT event_id, ts, value, p // ((n + 5) // 6) AS frame, p // ((n + 5) // 6) // 2 AS batch_id FROM p""")
def frame_stream(spark, folder):
    """Two of six frames make a batch; the query is stopped after the first batch and started again."""
    events = table(spark, folder, "events").select("event_id", "ts", "value")
    framed = replay.replay_table(events, ["ts", "event_id"], -(-events.count() // 6) or 1, "2024-06-01", "250ms").drop("replay_ts")
    stored, path, progress = scratch_path(spark, "frames"), scratch_path(spark, "out"), scratch_path(spark, "progress")
    replay.write_frames(framed, stored, ["ts", "event_id"])
    stream = frames.frame_stream(spark, stored, 2, schema=framed.schema)
    live.micro_batch(stream, live.parquet_sink(path), progress, None).awaitTermination()
    rest = live.micro_batch(stream, live.parquet_sink(path), progress, "0 seconds")
    try:
        rest.processAllAvailable()
    finally:
        rest.stop()
    rows = spark.read.option("basePath", path).schema(batch_schema(stream)).parquet(path + "/batch_id=*")
    return rows.select("event_id", "ts", "value", "frame", "batch_id")


def batch_schema(stream):
    return T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])


@query(OUTAGES_SQL)
def mask_outages_stream_batches(spark, folder):
    """The masking of ``mask_outages`` over a stream in four batches."""
    stream = played_events(spark, folder, with_trigger, frames=4)
    masked = mask_outages_stream(stream, "user_id", ["ts"], "trigger", ["value"])
    return collected(masked).select("event_id", "value", "status")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def expire_old(spark, folder):
    return live.expire_old(table(spark, folder, "events").select("event_id", "ts"), "ts", "10d")


@query(view_sql(
    "SELECT event_type, value::DECIMAL(18,2) AS price, ts FROM events ORDER BY ts DESC LIMIT 5000", ["event_type"],
    {"value": mean_sql("price"), "ts": "max(ts) {f}"},
))
def live_view(spark, folder):
    """The view over the newest 5000 rows after the last batch."""
    stream = batches(spark, event_files(spark, folder), table(spark, folder, "events").schema).withColumn("value", money("value"))
    config = {"group_by": ["event_type"], "columns": ["value", "ts"], "aggregates": {"value": "mean", "ts": "last"}}
    paths = scratch_path(spark, "live"), scratch_path(spark, "view")
    run(stream, live.live_view(*paths, config, [("ts", "desc")], 5000, ["ts"]))
    return live.read_snapshot(spark, paths[1])


@query("SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders")
def incremental_append(spark, folder):
    """Two loads, the second of which repeats the keys of the first, give the table once."""
    path = scratch_path(spark, "store")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    first = orders.filter("o_orderpriority < '3'")
    live.incremental_append(first, path, "o_orderpriority", ["o_orderdate", "o_orderkey"])
    return live.incremental_append(orders, path, "o_orderpriority", ["o_orderdate", "o_orderkey"])


@query(view_sql(
    """SELECT event_type, value::DECIMAL(18,2) AS price, ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000""", ["event_type"],
    {"value": mean_sql("price"), "ts": "max(ts) {f}", "event_id": "max(event_id) {f}"},
))
def live_view_kept(spark, folder):
    """The same view, kept from stored parts over five batches: rows that drop out are taken back."""
    stream = batches(spark, event_files(spark, folder, 5), table(spark, folder, "events").schema, 1).withColumn("value", money("value"))
    config = {"group_by": ["event_type"], "columns": ["value", "ts", "event_id"], "aggregates": {"value": "mean", "ts": "last", "event_id": "max"}}
    paths = scratch_path(spark, "kept"), scratch_path(spark, "view")
    run(stream, maintained_view(*paths, config, [("ts", "desc"), ("event_id", "desc")], 5000, ["ts"]))
    return live.read_snapshot(spark, paths[1])


@query(OUTAGES_SQL)
def mask_outages_sink(spark, folder):
    """The masking of ``mask_outages`` over a stream in five batches, whose rows stay in the JVM."""
    stream = played_events(spark, folder, with_trigger, frames=5)
    path = scratch_path(spark, "masked")
    run(stream, outage_sink(path, scratch_path(spark, "open"), "user_id", ["ts"], "trigger", ["value"]))
    return spark.read.parquet(path + "/batch_id=*").select("event_id", "value", "status")


@query("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS arrived, sum(value::DECIMAL(18,2))::DOUBLE AS total
    FROM events GROUP BY ALL""")
def windows_and_late_rows(spark, folder):
    """One event in forty comes two batches late: what windows and late rows hold together is the input."""
    def shuffled(events):
        kept = events.select("event_id", "ts", "event_type", money("value").alias("value"))
        held = F.when(F.xxhash64("event_id") % 40 == 0, F.make_dt_interval(days=F.lit(12))).otherwise(F.make_dt_interval())
        return kept.withColumn("turn", F.col("ts") + held)

    stream = played_events(spark, folder, shuffled, order=["turn", "event_id"])
    paths = scratch_path(spark, "windows"), scratch_path(spark, "late")
    sums = {"n": ("count", "event_id"), "total": ("sum", "value")}
    run(stream, live.windows_and_late_rows(*paths, "ts", "1 hour", ["event_type"], sums, "10 minutes"))
    named = ["window_start", "event_type", "n", "total"]
    late = spark.read.parquet(paths[1] + "/batch_id=*")
    counted = late.groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("window_start"), "event_type").agg(
        F.count("event_id").alias("n"), F.sum("value").alias("total"))
    every = spark.read.parquet(paths[0] + "/batch_id=*").select(*named).unionByName(live.open_windows(spark, paths[0]).select(*named)).unionByName(counted)
    result = every.groupBy("window_start", "event_type").agg(F.sum("n").alias("arrived"), F.sum("total").cast("double").alias("total"))
    return result.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
    WITH p AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events)
    SELECT event_id, value, p // ((n + 3) // 4) AS poll FROM p""")
def poll_new(spark, folder):
    """Polls of a quarter of the table each, which read on from a stored mark until nothing is left."""
    events = table(spark, folder, "events").select("event_id", "ts", "value")
    most = -(-events.count() // 4)
    path, marks = scratch_path(spark, "polled"), scratch_path(spark, "marks")
    number, more = 0, True
    while more:
        recent.poll_new(events, "ts", ["event_id"], marks, most).write.parquet(f"{path}/poll={number}")
        more = recent.keep_mark(spark.read.parquet(f"{path}/poll={number}"), "ts", ["event_id"], marks)
        number += 1
    rows = spark.read.option("basePath", path).schema(T.StructType([*events.schema.fields, T.StructField("poll", T.LongType())])).parquet(path + "/poll=*")
    return rows.select("event_id", "value", "poll")
