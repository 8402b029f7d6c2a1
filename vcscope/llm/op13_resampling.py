"""Target-distribution importance resampling of documents towards a target text set.

Features are a text's words and pairs of neighbouring words, hashed into buckets by
CRC-32. Counting both tables gives each bucket a gain, the floored log ratio of its
shares; the ``BUCKETS`` gains are one array (the only thing that goes through the
driver), and a document's weight is the mean gain of its features, looked up array
by array. Gumbel noise drawn from the doc_id turns weights into scores, so that the
highest scores are a sample without replacement.

Scores are written once. The cutoff is a (score, doc_id) that exactly the asked
number of documents reach: a bisection over the score, then over the doc_ids tied
at it. Each count job halves the bracket ``HALVINGS`` times at once, by counting in
every piece. Selected documents are put into ranges of (score, doc_id), and ranks
are a range's own order after the sizes of the ranges before it.

CRCs of many words at once: word by word in step, byte by byte; that of a pair
follows from those of its words, for CRC is linear: the first word's is moved on
by the second one's length (a table of each length) and combined.

Defined results: a null text has no words; a null doc_id draws its noise as an empty
id and comes after others at equal scores; rows of one doc_id take ranks of their own,
in any order where all else is equal; without benchmark texts or features all
t are 0; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_arrow, shuffle_partitions, slices, stage, table
from .spans import batch_bytes, blocks, transitions, word_spans

BUCKETS = 10_000
SEED = 7
MIN_WORDS, DRAW_PERCENT = 20, 25
# A count job cuts its bracket into 2 ** HALVINGS pieces.
HALVINGS = 4

WORD = 1


def _classes() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256)
    lower = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint8)
    word = (code >= 0x80) | ((code >= 0x30) & (code <= 0x39)) | ((code >= 0x61) & (code <= 0x7A))
    return lower, word[lower].astype(np.uint8) * WORD


# Lower case of A-Z alone, and the class of each byte once lowered.
LOWER, CLASSES = _classes()
IS_WORD = CLASSES != 0
NEXT_STATE = transitions(CLASSES, WORD)

# Words up to this length run through the tables.
TABLE_LENGTH = 256


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


CRC = _crc_table()
_shift: list[np.ndarray] = []


def _shift_tables() -> np.ndarray:
    """[n][k][b]: the register with byte k set to b, moved on by n zero bytes."""
    if not _shift:
        out = np.empty((TABLE_LENGTH + 1, 4, 256), dtype=np.uint32)
        out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for n in range(TABLE_LENGTH):
            out[n + 1] = CRC[out[n] & 255] ^ (out[n] >> 8)
        _shift.append(out)
    return _shift[0]


def _long_crc(low: np.ndarray, start: int, n: int, before: int = 0) -> int:
    return zlib.crc32(memoryview(low)[start:start + n], before)


def word_crcs(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    out = np.empty(len(starts), dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    order = order[:np.searchsorted(lengths[order], TABLE_LENGTH, "right")]
    n, at = lengths[order], starts[order]
    reg = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(int(n[-1]) if len(n) else 0):
        k = int(np.searchsorted(n, j, "right"))  # the words that go on
        r = reg[k:]
        reg[k:] = CRC[(r ^ low[at[k:] + j]) & 255] ^ (r >> 8)
    out[order] = ~reg
    for i in np.flatnonzero(lengths > TABLE_LENGTH):
        out[i] = _long_crc(low, int(starts[i]), int(lengths[i]))
    return out


def pair_crcs(low: np.ndarray, crcs: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
              first: np.ndarray) -> np.ndarray:
    """CRC-32 of word ``first``, a space and the word after it."""
    reg = ~crcs[first]
    spaced = ~(CRC[(reg ^ 0x20) & 255] ^ (reg >> 8))
    n = np.minimum(lengths[first + 1], TABLE_LENGTH)
    t = _shift_tables()
    out = crcs[first + 1].copy()
    for k in range(4):
        out ^= t[n, k, (spaced >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(lengths[first + 1] > TABLE_LENGTH):
        w = int(first[i]) + 1
        out[i] = _long_crc(low, int(starts[w]), int(lengths[w]), int(spaced[i]))
    return out


def features(data: np.ndarray, offsets: np.ndarray, block: int = 4 << 20):
    """For each block of bytes (texts, buckets of words, texts, buckets of pairs):
    the text of each feature and its bucket. A pair across two blocks of one text
    comes with the second."""
    kept = None  # text and place of the last word of the block before
    for lo, hi in blocks(data, offsets, IS_WORD, block):
        first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
        at = np.clip(offsets[first:last + 1] - lo, 0, hi - lo)
        starts, ends = word_spans(CLASSES[data[lo:hi]], NEXT_STATE, at)
        texts = np.searchsorted(at, starts, "right") - 1 + first
        starts, lengths, base = starts + lo, ends - starts, lo
        carried = kept is not None and len(texts) and texts[0] == kept[0]
        if carried:
            base = kept[1]
            texts = np.concatenate([[kept[0]], texts])
            starts, lengths = np.concatenate([[kept[1]], starts]), np.concatenate([[kept[2]], lengths])
        low = LOWER[data[base:hi]]
        starts = starts - base
        crcs = word_crcs(low, starts, lengths)
        pairs = np.flatnonzero(texts[1:] == texts[:-1])
        both = pair_crcs(low, crcs, starts, lengths, pairs)
        own = slice(1, None) if carried else slice(None)
        yield texts[own], crcs[own] % BUCKETS, texts[pairs], both % BUCKETS
        if len(texts):
            kept = (int(texts[-1]), int(starts[-1]) + base, int(lengths[-1]))


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: features of all texts; a task sends at most ``BUCKETS`` rows."""
    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in slices(batches):
            for _, one, _, two in features(*batch_bytes(b)):
                total += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    return map_arrow(texts.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, from the counts of all documents and of the targets."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def _collected(counts: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in counts.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    def run(batches):
        for b in slices(batches):
            n = b.num_rows
            words, pairs, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for t1, one, t2, two in features(*batch_bytes(b)):
                words += np.bincount(t1, minlength=n)
                pairs += np.bincount(t2, minlength=n)
                for t, bucket in ((t1, one), (t2, two)):
                    # Sums over each text's run of features, exact in integers.
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                    total += np.diff(sums[np.searchsorted(t, np.arange(n + 1))])
            count = words + pairs
            weight = np.floor_divide(total, np.maximum(count, 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x) for x in (words, count, weight))],
                ["doc_id", "n_words", "n_features", "weight"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """The floored Gumbel draw of a doc_id, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and ``row``, written."""
    gain = gains(_collected(bucket_counts(docs)), _collected(bucket_counts(target)))
    rows = weighed(docs, gain).withColumn("score", F.col("weight") + noise())
    # Ties go to the smaller doc_id, null last; ``row`` tells repeated rows apart.
    return stage(rows.withColumn("place", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
                 .withColumn("row", F.monotonically_increasing_id()), "scores")


def _pieces(lo: int, hi: int) -> list[int]:
    """Bounds within (lo, hi], hi last: 2 ** HALVINGS pieces or single values."""
    n = min(1 << HALVINGS, hi - lo)
    return [lo + (hi - lo) * (i + 1) // n for i in range(n)]


def cut(rows: DataFrame, key: str, wanted: int) -> tuple[int, int, int]:
    """The least value v of ``key`` that at least ``wanted`` rows (from 1 to all)
    do not exceed, how many are less, and how many do not exceed it."""
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    # Keys up to lo: below < wanted; keys up to hi: upto >= wanted.
    lo, below, upto = lo - 1, 0, None
    while upto is None or hi - lo > 1:
        bounds = _pieces(lo, hi)
        # Only the bracket is read; how much lies before it is known.
        got = rows.where(F.col(key).between(lo + 1, hi)).agg(
            *[F.count_if(F.col(key) <= b).alias(f"c{i}") for i, b in enumerate(bounds)]).first()
        counts = [below + c for c in got]
        i = next(i for i, c in enumerate(counts) if c >= wanted)
        if i:
            lo, below = bounds[i - 1], counts[i - 1]
        hi, upto = bounds[i], counts[i]
    return hi, below, upto


def reaches(rows: DataFrame, wanted: int) -> Column:
    """Whether a row is among the first ``wanted`` by descending score, place, row."""
    taken, tied = F.lit(False), F.lit(True)
    if wanted <= 0:
        return taken
    at = rows.withColumn("_less", -F.col("score"))
    for name, key in (("_less", -F.col("score")), ("place", F.col("place")), ("row", F.col("row"))):
        value, below, upto = cut(at, name, wanted)
        taken, tied = taken | (tied & (key < value)), tied & (key == value)
        if upto == wanted:  # all that tie belong to them
            return taken | tied
        at, wanted = at.where(F.col(name) == value), wanted - below
    return taken


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3… by descending score, place, row."""
    spark, order = rows.sparkSession, [F.desc("score"), F.asc("place"), F.asc("row")]
    # Written, because the ranges' bounds come from a sample.
    ranges = stage(rows.repartitionByRange(shuffle_partitions(spark), *order).withColumn(
        "piece", F.spark_partition_id()), "ranges")
    sizes = sorted(tuple(r) for r in ranges.groupBy("piece").count().collect())  # one row a range
    before, rows_before = [], 0
    for piece, n in sizes:
        before.append((piece, rows_before))
        rows_before += n
    offsets = spark.createDataFrame(before, "piece int, rows_before long")
    within = F.row_number().over(Window.partitionBy("piece").orderBy(*order))
    return ranges.withColumn("within", within).join(F.broadcast(offsets), "piece").withColumn(
        "rank", F.col("rows_before") + F.col("within"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAW_PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn) of every row."""
    rows = scored(docs, target)
    able = F.col("n_words") >= MIN_WORDS
    wanted = percent * rows.where(able).count() // 100
    chosen = able & reaches(rows.where(able), wanted)
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked(rows.where(chosen)).select(*out, "rank").unionByName(
        rows.where(~chosen).select(*out, F.lit(None).cast("long").alias("rank")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


# CRC-32 by its rule: eight shifts of a byte make a table's entry.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(0, octet_length(encode(f))), lambda i: CAST(('0x' || substr(hex(encode(f)), 2 * i + 1, 2)) AS BIGINT))),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])))"""


def _features_sql(name: str, source: str) -> str:
    return rf"""{name}_w AS (SELECT id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT {source}, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t
    FROM {name})),
{name}_f AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
  FROM {name}_w)"""


ORACLE_SQL = rf"""WITH {_features_sql("documents", "doc_id AS id")},
{_features_sql("benchmark", "item_id AS id")},
crc_table AS (SELECT list(c ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, range(1, 9)),
  lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
  FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS b))),
buckets AS (SELECT f, {_CRC} % {BUCKETS} AS bucket
  FROM (SELECT f FROM documents_f UNION SELECT f FROM benchmark_f), crc_table),
s AS (SELECT bucket, count(*) AS n FROM documents_f JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM benchmark_f JOIN buckets USING (f) GROUP BY bucket),
gains AS (SELECT s.bucket, CAST(floor(1000 * ln(
    ((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {BUCKETS})::DOUBLE)
    / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket),
sums AS (SELECT id, count(*) AS n, sum(gain) AS gain FROM documents_f JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY id),
scores AS (SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n, 0) AS n_features,
    CAST(coalesce(floor(gain / n), 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{SEED}:' || w.id), 1, 8)) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM documents_w w LEFT JOIN sums ON sums.id = w.id),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank,
    count(*) OVER () AS able FROM scores WHERE n_words >= {MIN_WORDS})
SELECT s.doc_id, s.n_features, s.weight, s.weight + s.noise AS score,
  CASE WHEN d.rank <= {DRAW_PERCENT} * d.able // 100 THEN d.rank END AS rank
FROM scores s LEFT JOIN drawn d ON d.doc_id = s.doc_id"""
