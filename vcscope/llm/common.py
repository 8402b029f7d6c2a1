"""Shared pieces of the corpus operators: tables, written intermediates, words."""

from __future__ import annotations

import atexit
import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Slices bound what a task holds in Python: about so many bytes of text at once.
SLICE_BYTES = 4 << 20
# Arrow batches are held whole outside the heap by the executor and by its Python
# worker. A little under a slice, as a batch ends with the row that reaches its limit.
BATCH_BYTES = SLICE_BYTES // 8 * 7
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
# Entries of a per-process memo; when full it is emptied (it only saves time).
MEMO_ENTRIES = 500_000

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# -- written intermediates ---------------------------------------------------

_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session has ended; the folder is the cluster's to clean
            pass


atexit.register(_remove_written)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: lineage is cut and every later reader sees the same rows, also when
    executors are lost. Removed when the driver's process ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# -- Python workers ----------------------------------------------------------

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once an application), and
    rows in batches of about BATCH_BYTES, unless the session says otherwise."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for d, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    import tempfile
    out = os.path.join(tempfile.mkdtemp(prefix="vcscope-ship-"), "vcscope_llm_src.zip")
    with open(out, "wb") as fh:  # the driver's own file; Spark serves it to the executors
        fh.write(buf.getvalue())
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each part holds about ``limit`` bytes of text
    (one document at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = [x or 0 for x in pc.binary_length(col).to_pylist()]
        start = total = 0
        for i, s in enumerate(sizes):
            if i > start and total + s > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += s
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is the empty text."""
    col = batch.column(batch.schema.get_field_index(text))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes, block: int = 8 << 20) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in lists of bounded size
    (``bytes.split`` separates at exactly these characters)."""
    start, n = 0, len(data)
    while n - start > block:
        m = _SPACE.search(data, start + block)
        if not m:
            break
        yield data[start:m.start()].split()
        start = m.end()
    yield data[start:].split() if start else data.split()


class Memo(dict):
    """key → ``fn(key)``, remembered up to MEMO_ENTRIES keys of moderate size."""

    def __init__(self, fn, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.fn, self.entries = fn, entries

    def __missing__(self, key):
        v = self.fn(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[key] = v
        return v


# Not remembered: hashing a word again takes less time than looking it up, and no memory.
word_hash = xxhash.xxh3_64_intdigest


def null_text(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
