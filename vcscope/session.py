"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Timestamps are UTC everywhere (commit dates are
# stored normalised to UTC), AQE re-plans joins and coalesces partitions at run
# time and splits skewed join partitions.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "vcscope") -> SparkSession:
    """Session for tests and local runs. On a cluster, use the cluster's
    session and call :func:`configure` on it instead."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("VCSCOPE_DRIVER_MEMORY", "16g"))
    )
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings the operators depend on. The time zone is
    essential; the others only tune, and a cluster may lock them."""
    for k, v in SESSION_DEFAULTS.items():
        if k != "spark.sql.session.timeZone" and spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` (or the SparkContext's checkpoint dir). Only
    on a local master with neither set (local runs and tests) a scratch folder is
    created and registered, so that ``DataFrame.checkpoint()`` works."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="vcscope-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_staged: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_staged() -> None:
    for spark, path in _staged:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder is the cluster's to clean
            pass


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, removed when the driver's process ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/vcscope-{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Bytes of input files (compressed) for which a shuffle has a partition.
PARTITION_BYTES = 16 << 20


def fit_partitions(spark: SparkSession, input_bytes: int) -> None:
    """As many shuffle partitions as the input needs not to be spilled when it is sorted;
    Spark joins small ones again. Never fewer than the session's."""
    n = -(-input_bytes // PARTITION_BYTES)
    if n > partitions(spark) and spark.conf.isModifiable(_INITIAL):
        spark.conf.set(_INITIAL, str(n))


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle before small ones are joined."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(_INITIAL, None) or 0))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files (where Spark can remove them): what is
    written is read from then on, so a long job holds the shuffles of one step at a time."""
    if not spark.conf.isModifiable(_CLEANUP):
        yield
        return
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back:
    computed once for all readers, and never again when executors are lost. Removed
    when the driver's process ends."""
    path = scratch_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
