"""What executors and their Python workers hold at once."""

import tracemalloc

import pyarrow as pa

from vcscope.llm import bpe, op1_jaccard, op10_quality
from vcscope.llm.common import SLICE_BYTES, map_arrow


def batch_sizes(rows):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())],
                                             ["n", "size"])

    return map_arrow(rows, sizes, "n long, size long").collect()


def test_rows_reach_python_in_small_batches(spark):
    rows = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "repeat('x', 500000) AS text")
    got = batch_sizes(rows)
    assert sum(r.n for r in got) == 60
    assert max(r.size for r in got) <= SLICE_BYTES + 500_100


def test_batch_size_of_the_session_stays(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    got = batch_sizes(own.range(0, 20, 1, 1).selectExpr("id AS doc_id", "repeat('x', 500000) AS text"))
    assert sum(r.n for r in got) == 20 and max(r.size for r in got) <= (1 << 20) + 500_100
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"


def test_words_of_earlier_texts_are_not_held():
    tracemalloc.start()
    try:
        for k in range(4):
            text = b" ".join(b"word%d" % i for i in range(50_000 * k, 50_000 * (k + 1)))
            assert len(op1_jaccard.shingles(text)) == 49_997
            assert op10_quality._measure(text, b"")[0] == 50_000
        del text
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 4 << 20


def test_words_of_a_packing_task_are_not_held():
    path = bpe.tokenizer_path(bpe.WORD_LEVEL)
    bpe.load(path, False)
    tracemalloc.start()
    try:
        for k in range(2):
            text = b" ".join(b"word%d" % i for i in range(50_000 * k, 50_000 * (k + 1)))
            assert len(bpe.id_bytes_many([text], bpe.word_ids(path))[0]) > 4 * 50_000
        del text
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 4 << 20
