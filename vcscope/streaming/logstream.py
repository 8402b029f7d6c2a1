"""Incremental indexing: new log dumps landing in a folder are parsed and added
to the table store with Structured Streaming.

Each micro-batch takes whole new files, parses them like the batch index and
writes its tables into a folder of its own, ``batch=<id>``, overwriting what an
earlier try of the same batch left, so a retried batch adds nothing twice. A commit
that a batch before has is left out: the first record of a hash counts, within a
batch and across batches. A dump is read once under its name; branches and tags
need a full index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schema import COMMITS
from ..session import staged
from ..sources import gitlog


def read_log_stream(spark: SparkSession, dump_dir: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming stretches between record separators of ``*.log`` files."""
    return (spark.readStream.format("text").option("lineSep", gitlog.RECORD_SEP)
            .option("pathGlobFilter", "*.log").option("maxFilesPerTrigger", max_files_per_trigger)
            .load(dump_dir).select("value", "_metadata.file_name", "_metadata.file_path",
                                   "_metadata.file_block_start"))


def _earlier(spark: SparkSession, out: str, batch_id: int) -> DataFrame | None:
    """repo_name, commit_hash of the batches before, from the column they are found by."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}/commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    ids = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path)] if fs.exists(path) else []
    if not any(i < batch_id for i in ids):
        return None
    rows = spark.read.schema(COMMITS).option("basePath", path.toString()).parquet(
        *[f"{path}/batch={i}" for i in ids if i < batch_id])
    return rows.select("repo_name", "commit_hash").distinct()


def _write_batch(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        records, lost = gitlog.join_bodies(staged(gitlog.with_place(batch), "stream-fragments"))
        parsed = gitlog.parse_commits(records)
        known = _earlier(batch.sparkSession, out, batch_id)
        if known is not None:
            parsed = parsed.join(known, ["repo_name", "commit_hash"], "left_anti").select(*parsed.columns)
        parsed = staged(parsed, "stream-parsed")
        for name, df in (("commits", gitlog.commit_table(parsed)), ("file_changes", gitlog.file_changes(parsed)),
                         ("commit_parents", gitlog.commit_parents(parsed)),
                         ("rejects", lost.unionByName(gitlog.bad_dates(parsed)))):
            df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}/batch={batch_id}")
    return write


def start_log_indexing(spark: SparkSession, dump_dir: str, out: str, checkpoint: str,
                       once: bool = False) -> StreamingQuery:
    """Start the stream; ``once`` processes what is there and stops."""
    w = read_log_stream(spark, dump_dir).writeStream.foreachBatch(_write_batch(out)).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()
