"""Named, deterministic queries: name → operator over the history tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, configure, fit_partitions
from ..tables import Tables

Operator = Callable[[Tables], DataFrame]

REGISTRY: dict[str, Operator] = {}


def register(name: str):
    def deco(fn: Operator) -> Operator:
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = fn
        return fn
    return deco


_lock = threading.Lock()
_indexed: dict[tuple, Tables] = {}


def _fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, size and time of the input files, from the file system they are in."""
    base = sf_dir.rstrip("/")
    stats = []
    for name in ("orders", "customer", "lineitem", "part"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}.parquet")
        st = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        stats.append((name, st.getLen(), st.getModificationTime()))
    return (base, tuple(stats))


def index_tables(spark: SparkSession, sf_dir: str, out: str | None = None) -> Tables:
    """Build the history tables from the driver tables, each once and when a query
    first reads it, write them as parquet (partitioned by repository) to the shared
    checkpoint folder and read them back: queries then start from the written tables, with no
    lineage back to the raw inputs (the index step of the reference)."""
    from ..sources import fixtures

    configure(spark)
    key = (spark.sparkContext.applicationId, _fingerprint(spark, sf_dir))
    fit_partitions(spark, sum(size for _, size, _ in key[1][1]))
    with _lock:
        if key not in _indexed:
            path = out or f"{checkpoint_dir(spark).rstrip('/')}/vcscope-tables-{uuid.uuid4().hex}"
            # One handle, so that queries share what they derive.
            _indexed[key] = fixtures.lazy_index(spark, sf_dir, path)
        return _indexed[key]


def run(name: str, spark: SparkSession, sf_dir: str, from_: str | None = None, to: str | None = None,
        repos: list[str] | None = None) -> DataFrame:
    """A catalogue query, of a date range or of some repositories if given."""
    import vcscope.operators  # noqa: F401  (registers every operator)
    t = index_tables(spark, sf_dir).between(from_, to)
    return REGISTRY[name](t.of_repos(*repos) if repos else t)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import vcscope.operators  # noqa: F401
    return {name: (lambda spark, sf_dir, _n=name: run(_n, spark, sf_dir)) for name in REGISTRY}
