"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings every job here relies on; cluster sizing is left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot leaves methods above 8000 bytes of bytecode uncompiled; beyond that Spark does better
    # with one compiled method per operator than with one interpreted method per stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.checkpoint.compress": "true",
    "spark.ui.enabled": "false",
}
# The part of them that can be set on a running session.
RUNTIME = ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit")


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session started elsewhere the settings results and speed depend on."""
    for key in RUNTIME:
        spark.conf.set(key, DEFAULTS[key])
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tickloom")
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **extra}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local-mode session that names none gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, with the same partitions in the same order."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of ``path`` on whatever file system it lives; empty if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def put_line(spark: SparkSession, path: str, line: str) -> None:
    """A one-line file that is there as a whole or not at all, replacing one of that name: written beside it, then renamed."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    stream.write(bytearray(line.encode()))
    stream.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"cannot rename to {path}")


def get_line(spark: SparkSession, path: str) -> str:
    """What :func:`put_line` wrote."""
    return spark.read.text(path).first()[0]


def delete_dir(spark: SparkSession, path: str) -> None:
    """Remove one folder this library wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
