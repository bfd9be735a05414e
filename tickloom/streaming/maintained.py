"""A live view that is kept, not recomputed.

The live table holds the first ``limit`` rows of a stream by some order. Its view is stored as mergeable parts (sums, counts,
extremes, newest values, and counts of values for ``dominant``) per group and split value. A batch aggregates its own rows
and merges the result into the parts of the groups it touches. Rows that drop out of the live table are taken back from
sums and counts. Where that is not exact (floating point) or not possible (the extreme or the newest value left), the group is
computed anew from its own rows.

Stored below one folder, all by batch, so that a repeated batch replaces itself:

    rows/batch_id=B/bucket=K     the batch's raw rows; a bucket holds the groups of one hash
    ledger/version=B             (batch_id, id, bucket, worth, order columns) of the live rows of the batches B has changed
    parts/version=B/bucket=K     the parts of every group of the buckets B has changed
    counts-I/version=B/bucket=K  the same for the values of column I
    state/version=B              one line of JSON: where the newest piece of everything lies

So a batch reads raw rows of buckets only that hold a group with a row that leaves, and the narrow ledger of the batches its
leaving rows come from, which are found by each batch's lowest and highest place in the order.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.ordering import Order, head
from tickloom.operators.series import ordinal
from tickloom.plans.view import MAX_SPLITS, ViewPlan, q, same, split_values
from tickloom.session import delete_dir, list_dir
from tickloom.streaming.live import Sink, snapshot_versions, write_version

BUCKETS = 256
KEEP = 3
ID, BUCKET, BATCH, WORTH = "__id", "__bucket", "batch_id", "__worth"


def worth(df: DataFrame, order: Order) -> Column:
    """A number that never grows along the order: rows that are kept longer are worth more."""
    name, direction = (order, "asc") if isinstance(order, str) else order
    position = ordinal(df, name)
    position = F.when(F.isnan(position), F.lit(float("inf"))).otherwise(position)
    signed = -position if direction == "asc" else position
    return F.coalesce(signed, F.lit(float("-inf")))


def reversed_columns(order: Sequence[Order]) -> list[Column]:
    """The opposite of ``order_columns``, nulls first."""
    columns = []
    for item in order:
        name, direction = (item, "asc") if isinstance(item, str) else item
        columns.append(F.col(name).desc_nulls_first() if direction == "asc" else F.col(name).asc_nulls_first())
    return columns


class MaintainedView:
    """The stored state below ``path`` of one view over one live table, and what a batch does to it."""

    def __init__(self, path: str, config: Mapping, order: Sequence[Order], limit: int, order_by: Sequence[str] = (),
                 buckets: int = BUCKETS, **options):
        self.path, self.config, self.order, self.limit = path, config, list(order), limit
        self.order_by, self.buckets, self.options = order_by, buckets, options
        self.names = [o if isinstance(o, str) else o[0] for o in order]

    # --- reading what is stored

    def state(self, spark: SparkSession, before: int | None = None) -> dict:
        versions = [v for v in snapshot_versions(spark, f"{self.path}/state") if before is None or v < before]
        if not versions:
            return {"version": -1, "batches": {}, "parts": {}, "counts": {}}
        return json.loads(spark.read.text(f"{self.path}/state/version={versions[-1]}").first()[0])

    def raw_rows(
        self, spark: SparkSession, schema: T.StructType, batches: Sequence[str], buckets: Sequence[int] | None = None
    ) -> DataFrame:
        """Stored rows of some batches and buckets, or of all buckets; no other folder is read."""
        own = [(BUCKET, T.IntegerType()), (ID, T.LongType()), (BATCH, T.LongType()), ("bucket", T.IntegerType())]
        schema = T.StructType([*schema.fields, *[T.StructField(*f) for f in own]])
        folders = [f"{self.path}/rows/batch_id={b}" for b in batches]
        if buckets is not None:
            wanted = {f"bucket={b}" for b in buckets}
            folders = [f"{folder}/{name}" for folder in folders for name in list_dir(spark, folder) if name in wanted]
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*folders)

    def _ledger(self, spark: SparkSession, state: dict, batches: Sequence[str]) -> DataFrame:
        """The live rows of some batches, narrow."""
        where: dict[int, list[int]] = {}
        for b in batches:
            where.setdefault(state["batches"][b]["ledger"], []).append(int(b))
        found = None
        for version, ids in where.items():
            part = spark.read.parquet(f"{self.path}/ledger/version={version}").filter(F.col(BATCH).isin(ids))
            found = part if found is None else found.unionByName(part)
        return found

    def _stored(self, spark: SparkSession, name: str, where: Mapping[str, int], buckets: Sequence[int] | None) -> DataFrame | None:
        """The newest parts of some buckets, or of all."""
        chosen = [(v, k) for k, v in where.items() if buckets is None or int(k) in buckets]
        if not chosen:
            return None
        return spark.read.parquet(*[f"{self.path}/{name}/version={v}/bucket={k}" for v, k in chosen])

    def table(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The live rows as the newest batch left them."""
        state = self.state(spark)
        if not state["batches"]:
            return spark.createDataFrame([], schema)
        batches = list(state["batches"])
        live = self._ledger(spark, state, batches).select(BATCH, ID)
        rows = self.raw_rows(spark, schema, batches)
        return rows.join(live, [BATCH, ID], "left_semi").select(*schema.names)

    def view(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The view from the stored parts."""
        none = spark.createDataFrame([], schema)
        plan, state = self._plan(none), self.state(spark)
        nothing = plan.prepared(plan.base(none))
        leaf = self._stored(spark, "parts", state["parts"], None)
        leaf = plan.leaf(nothing) if leaf is None else leaf
        counts = {i: self._stored(spark, f"counts-{i}", state["counts"].get(str(i), {}), None) for i in plan.dominant}
        counts = {i: plan.counts(nothing, plan.dominant[i]) if c is None else c for i, c in counts.items()}
        columns = plan.split and plan.layout == "columns"
        return plan.finish(leaf, counts, split_values(leaf, "__s", MAX_SPLITS) if columns else None)

    def _plan(self, rows: DataFrame) -> ViewPlan:
        return ViewPlan(rows, self.config, self.order_by, **self.options)

    # --- a batch

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Bring the state to version ``batch_id``."""
        spark = batch.sparkSession
        state = self.state(spark, batch_id)
        state["version"] = batch_id
        plan = self._plan(batch)
        arrived = self._store_rows(batch, batch_id, plan)
        names = [BATCH, ID, BUCKET, WORTH, *self.names]
        ledger = arrived.withColumns({BATCH: F.lit(batch_id).cast("bigint"), WORTH: worth(arrived, self.order[0])}).select(*names).persist()
        leaving = None
        try:
            ends = ledger.agg(F.count(F.lit(1)).alias("n"), F.min(WORTH).alias("low"), F.max(WORTH).alias("high")).first()
            if ends["n"]:
                state["batches"][str(batch_id)] = {"live": ends["n"], "low": ends["low"], "high": ends["high"], "ledger": batch_id}
            leaving = self._leaving(spark, state, ledger, batch_id)
            lost = {} if leaving is None else {str(r[0]): r[1] for r in leaving.groupBy(BATCH).count().collect()}
            self._store_ledger(spark, state, ledger, leaving, lost, batch_id)
            self._update_parts(spark, batch.schema, plan, arrived, state, leaving, lost)
        finally:
            ledger.unpersist()
            if leaving is not None:
                leaving.unpersist()
        line = spark.createDataFrame([(json.dumps(state),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{self.path}/state/version={batch_id}")
        self._clean(spark)

    def _store_rows(self, batch: DataFrame, batch_id: int, plan: ViewPlan) -> DataFrame:
        """The batch's rows that can be live, stored by bucket and read again."""
        keyed = plan.expressed(head(batch, self.limit, self.order))
        bucket = F.pmod(F.xxhash64(*[q(k) for k in (*plan.group_by, *plan.split_by)]), F.lit(self.buckets)).cast("int")
        dealt = keyed.select(*[q(c) for c in batch.columns], bucket.alias(BUCKET)).repartition(BUCKET)
        rows = dealt.withColumns({ID: F.monotonically_increasing_id(), "bucket": F.col(BUCKET)})
        target = f"{self.path}/rows/batch_id={batch_id}"
        rows.write.mode("overwrite").partitionBy("bucket").parquet(target)
        return batch.sparkSession.read.schema(rows.drop("bucket").schema).parquet(target)

    def _leaving(self, spark: SparkSession, state: dict, ledger: DataFrame, batch_id: int) -> DataFrame | None:
        """(batch_id, id, bucket) of the rows beyond the limit, the last ones in the order."""
        batches = state["batches"]
        excess = sum(b["live"] for b in batches.values()) - self.limit
        if excess <= 0:
            return None
        # Up to this worth there are enough rows: whole batches lie below it.
        seen, bound = 0, None
        for b in sorted(batches.values(), key=lambda b: b["high"]):
            seen, bound = seen + b["live"], b["high"]
            if seen >= excess:
                break
        touched = [k for k, b in batches.items() if b["low"] <= bound and int(k) != batch_id]
        found = self._ledger(spark, state, touched).unionByName(ledger) if touched else ledger
        last = [*reversed_columns(self.order), F.col(BATCH).desc(), F.col(ID).desc()]
        return found.filter(F.col(WORTH) <= bound).orderBy(*last).limit(excess).select(BATCH, ID, BUCKET).persist()

    def _store_ledger(
        self, spark: SparkSession, state: dict, ledger: DataFrame, leaving: DataFrame | None, lost: Mapping[str, int], batch_id: int
    ) -> None:
        """New versions of the ledgers of the new batch and of those that lose rows."""
        changed = [b for b in lost if int(b) != batch_id]
        rows = self._ledger(spark, state, changed).unionByName(ledger) if changed else ledger
        if leaving is not None:
            rows = rows.join(leaving.select(BATCH, ID), [BATCH, ID], "left_anti").select(*ledger.columns)
        rows.coalesce(8).write.mode("overwrite").parquet(f"{self.path}/ledger/version={batch_id}")
        for b, n in lost.items():
            state["batches"][b].update(live=state["batches"][b]["live"] - n, ledger=batch_id)
            if state["batches"][b]["live"] == 0:
                del state["batches"][b]

    def _update_parts(
        self, spark: SparkSession, schema: T.StructType, plan: ViewPlan, arrived: DataFrame, state: dict,
        leaving: DataFrame | None, lost: Mapping[str, int],
    ) -> None:
        """The parts of the groups in touched buckets, with the new rows in and the leaving ones out."""
        by_bucket = copy.copy(plan)
        by_bucket.group = [*plan.group, BUCKET]
        prepared = plan.prepared(plan.base(arrived), [BUCKET])
        losing = [] if leaving is None else [r[0] for r in leaving.select(BUCKET).distinct().collect()]
        touched = sorted({*losing, *[r[0] for r in arrived.select(BUCKET).distinct().collect()]})
        gone = None
        if losing:
            rows = self.raw_rows(spark, schema, list(lost), losing).join(leaving.select(BATCH, ID), [BATCH, ID], "left_semi")
            gone = plan.prepared(plan.base(rows), [BUCKET])

        parts, old = by_bucket.leaf(prepared), self._stored(spark, "parts", state["parts"], touched)
        if old is not None:
            parts = by_bucket.merged(old.unionByName(parts), by_bucket.group)
        judged = None
        if gone is not None:
            judged = retracted(by_bucket, parts, by_bucket.leaf(gone), prepared.schema).persist()
            parts = judged.filter("NOT __again").drop("__again")
            again = judged.filter("__again").select(*by_bucket.group)
            if again.head(1):
                parts = parts.unionByName(self._anew(spark, schema, by_bucket, again, state))
        self._write(spark, parts.filter(F.col("__rows") > 0), "parts", state["parts"], touched, state["version"])
        if judged is not None:
            judged.unpersist()

        for i, column in plan.dominant.items():
            where = state["counts"].setdefault(str(i), {})
            counts, old = by_bucket.counts(prepared, column), self._stored(spark, f"counts-{i}", where, touched)
            counts = counts if old is None else old.unionByName(counts)
            if gone is not None:
                counts = counts.unionByName(by_bucket.counts(gone, column).withColumn("__c", -F.col("__c")))
            summed = counts.groupBy(*by_bucket.group, "__v").agg(F.sum("__c").alias("__c")).filter(F.col("__c") > 0)
            self._write(spark, summed, f"counts-{i}", where, touched, state["version"])

    def _anew(self, spark: SparkSession, schema: T.StructType, by_bucket: ViewPlan, again: DataFrame, state: dict) -> DataFrame:
        """The parts of the groups ``again`` from their live rows."""
        buckets = [r[0] for r in again.select(BUCKET).distinct().collect()]
        batches = list(state["batches"])
        live = self._ledger(spark, state, batches).filter(F.col(BUCKET).isin(buckets)).select(BATCH, ID)
        rows = self.raw_rows(spark, schema, batches, buckets).join(live, [BATCH, ID], "left_semi")
        mine = by_bucket.prepared(by_bucket.base(rows), [BUCKET])
        side = again.withColumnsRenamed({c: f"__g{c}" for c in by_bucket.group})
        return by_bucket.leaf(mine.join(side, same(mine, side, by_bucket.group, "__g"), "left_semi"))

    def _write(self, spark: SparkSession, parts: DataFrame, name: str, where: dict, touched: Sequence[int], version: int) -> None:
        """Store touched buckets; those that came out empty are no longer listed."""
        target = f"{self.path}/{name}/version={version}"
        parts.repartition(BUCKET).withColumn("bucket", F.col(BUCKET)).write.mode("overwrite").partitionBy("bucket").parquet(target)
        written = {n.partition("=")[2] for n in list_dir(spark, target) if n.startswith("bucket=")}
        for k in map(str, touched):
            where.pop(k, None)
            if k in written:
                where[k] = version

    def _clean(self, spark: SparkSession) -> None:
        """Delete what none of the last states refers to."""
        versions = snapshot_versions(spark, f"{self.path}/state")
        states = [self.state(spark, v + 1) for v in versions[-KEEP:]]
        used = {"state": {str(v) for v in versions[-KEEP:]}, "rows": {b for s in states for b in s["batches"]},
                "ledger": {str(b["ledger"]) for s in states for b in s["batches"].values()},
                "parts": {str(v) for s in states for v in s["parts"].values()}}
        for i in {i for s in states for i in s["counts"]}:
            used[f"counts-{i}"] = {str(v) for s in states for v in s["counts"].get(i, {}).values()}
        for name, kept in used.items():
            for folder in list_dir(spark, f"{self.path}/{name}"):
                number = folder.partition("=")[2]
                if number.isdigit() and int(number) <= versions[-1] and number not in kept:
                    delete_dir(spark, f"{self.path}/{name}/{folder}")


def retracted(plan: ViewPlan, parts: DataFrame, gone: DataFrame, schema: T.StructType) -> DataFrame:
    """Parts less those of rows that are gone; ``__again`` marks groups whose rest cannot be told from the parts alone."""
    side = gone.withColumnsRenamed({c: f"__g{c}" for c in gone.columns})
    joined = parts.join(side, same(parts, side, plan.group, "__g"), "left")
    left = {"__rows": F.col("__rows") - F.coalesce(F.col("__g__rows"), F.lit(0))}
    unsure = F.lit(False)
    for m in plan.plain:
        a, b, ga, gb = F.col(m.a), F.col(m.b), F.col(f"__g{m.a}"), F.col(f"__g{m.b}")
        if m.how in ("mean", "sum"):
            left[m.b] = b - F.coalesce(gb, F.lit(0))
            rest = (a - F.coalesce(ga, F.lit(0).cast(parts.schema[m.a].dataType))).cast(parts.schema[m.a].dataType)
            left[m.a] = F.when(left[m.b] > 0, rest)
            if isinstance(schema[m.column].dataType, (T.FloatType, T.DoubleType)):
                unsure = unsure | (gb > 0)  # a difference of rounded sums is not the sum of the rest
        elif m.how == "count":
            left[m.a] = a - F.coalesce(ga, F.lit(0))
        elif m.how == "last" and len(m.order) == 1:
            unsure = unsure | (gb >= b)
        else:
            unsure = unsure | ((ga <= a) if m.how == "min" else (ga >= a))
    again = F.coalesce(unsure, F.lit(False)) & (left["__rows"] > 0)
    return joined.select(*[left.get(c, F.col(c)).alias(c) for c in parts.columns], again.alias("__again"))


def maintained_view(
    path: str, view_path: str, config: Mapping, order: Sequence[Order], limit: int, order_by: Sequence[str] = (),
    buckets: int = BUCKETS, **options,
) -> Sink:
    """A sink that keeps the first ``limit`` rows by ``order`` and, from stored parts, a view over them.

    The same rows as ``live_view``; each batch does work for the groups it touches. ``order`` should be unique.
    """
    kept = MaintainedView(path, config, order, limit, order_by, buckets, **options)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        kept.update(batch, batch_id)
        write_version(kept.view(batch.sparkSession, batch.schema), view_path, batch_id)

    return refresh
