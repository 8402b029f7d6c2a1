"""Quality rules: base counts of a text and line frequencies across documents.

Lines are normalised (lower case, digits as 0, single spaces) and hashed; for
each host (``source``) the distinct documents that hold a line are counted.
A line above the limit is boilerplate of its host and is removed from all but
the first document (by doc_id) that holds it; a document that keeps too few of
its words is depleted and rejected. Equal texts are one document here, so that
copies don't make a page's lines boilerplate; of many near copies the first stays.

Defined results: a null text counts as empty (no words, base_failed); a null
source is a host of its own; a null doc_id is kept; repeated rows each give
their row; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, ship, slices, stage, texts_of, word_blocks, word_hash

# Base rules.
MIN_WORDS = 50
MAX_REPEAT_SHARE = 50
# A line of a host is boilerplate if more distinct documents than this hold it.
LINE_DOCUMENTS = 10
# A document is depleted if less than this share (in percent) of its words remain.
MIN_REMAINING_SHARE = 50

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
_NORMAL = bytes.maketrans(b"0123456789", b"0000000000")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

STATS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
         "n_repeat_words long, signature long, line_keys array<long>, line_words array<int>")


def triples(hashes: np.ndarray) -> np.ndarray:
    """A hash of each window of three words."""
    t = (hashes[:-2] * _A + hashes[1:-1]) * _B + hashes[2:]
    t ^= t >> np.uint64(31)
    return t * _A


def repeated_words(tri: np.ndarray) -> int:
    """Words that some window found twice or more covers."""
    if not len(tri):
        return 0
    _, inv, n = np.unique(tri, return_inverse=True, return_counts=True)
    again = n[inv] >= 2
    covered = np.zeros(len(tri) + 2, dtype=bool)
    for k in range(3):
        covered[k:k + len(tri)] |= again
    return int(covered.sum())


def line_key(host: bytes, line: bytes) -> int:
    normal = b" ".join(line.lower().translate(_NORMAL).split())
    return xxhash.xxh3_64_intdigest(host + b"\x00" + normal) - (1 << 63)


def text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def host_key(host: str | None) -> bytes:
    return b"+" + host.encode() if host is not None else b"-"


def _measure(text: bytes, host: bytes):
    parts = [np.fromiter(map(word_hash, w), dtype=np.uint64, count=len(w))
             for w in word_blocks(text)]
    words = parts[0] if len(parts) == 1 else np.concatenate(parts)
    tri = triples(words) if len(words) >= 3 else words[:0]
    signature = text_key(text)
    lines: dict[bytes, int] = {}
    n_lines, held = 0, {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            n_lines += 1
            lines[line] = 0
            key = line_key(host, line)
            held[key] = held.get(key, 0) + n
    chars = len(text.decode())
    spaces = len(text) - len(text.translate(None, SPACES))
    return (len(words), chars - spaces, len(text) - len(text.translate(None, SYMBOLS)),
            n_lines - len(lines), repeated_words(tri), signature, list(held), list(held.values()))


def stats(docs: DataFrame) -> DataFrame:
    """STATS of every row of ``docs``."""
    def run(batches):
        for b in slices(batches):
            hosts = [host_key(h) for h in b.column("host").to_pylist()]
            rows = [_measure(t, h) for t, h in zip(texts_of(b), hosts)]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:6]),
                 pa.array(cols[6], pa.list_(pa.int64())), pa.array(cols[7], pa.list_(pa.int32()))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "signature", "line_keys", "line_words"])

    return map_arrow(docs.select("doc_id", "text", F.col("source").alias("host")), run, STATS)


def frequent_lines(measured: DataFrame, line_documents: int = LINE_DOCUMENTS) -> DataFrame:
    """key, owner: lines above the limit (keys hold the host) and the signature
    of the first document that holds them."""
    each = measured.select("doc_id", "signature", F.explode("line_keys").alias("key"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "signature")
    by_text = each.groupBy("key", "signature").agg(F.min(place).alias("first"))
    return (by_text.groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.min("first").alias("first"))
            .where(F.col("documents") > line_documents).select("key", F.col("first.signature").alias("owner")))


def _measured(docs: DataFrame) -> DataFrame:
    return stage(stats(docs).withColumn("row", F.monotonically_increasing_id()), "quality")


def _removed(measured: DataFrame, line_documents: int) -> DataFrame:
    """row, doc_id, signature, key, words: lines above the limit outside their first document."""
    lines = measured.select(
        "row", "doc_id", "signature", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l")).select(
        "row", "doc_id", "signature", F.col("l.line_keys").alias("key"), F.col("l.line_words").alias("words"))
    # Written, so that both sides are plain exchanges (or the list is broadcast for
    # its size) and the rows of a very frequent line can be split.
    frequent = stage(frequent_lines(measured, line_documents), "quality-lines")
    return lines.join(frequent, "key").where("signature != owner")


def _judged(measured: DataFrame, removed: DataFrame) -> DataFrame:
    gone = removed.groupBy("row").agg(F.sum("words").alias("gone"))
    remaining = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words")))
    return measured.join(gone, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * remaining >= MIN_REMAINING_SHARE * F.col("n_words"))).alias("kept"),
        remaining.alias("n_remaining_words"))


def judged(docs: DataFrame, line_documents: int = LINE_DOCUMENTS) -> DataFrame:
    """The base counts with base_failed, n_remaining_words and kept."""
    measured = _measured(docs)
    return _judged(measured, _removed(measured, line_documents))


def without_lines(text: bytes, host: bytes, keys: set[int]) -> bytes:
    """The text without its lines of the given keys."""
    return b"\n".join(x for x in text.split(b"\n") if not x.split() or line_key(host, x) not in keys)


def kept_documents(docs: DataFrame, line_documents: int = LINE_DOCUMENTS) -> DataFrame:
    """Rows of ``docs`` that the rules keep, without the lines above the limit
    outside their first document; n_chars follows the text. A doc_id given more
    than once stays if any of its rows is kept; rows without doc_id go."""
    ship(docs.sparkSession)
    measured = _measured(docs)
    removed = _removed(measured, line_documents)
    good = _judged(measured, removed).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    # By text too: of the rows of one doc_id, only one may hold a line's first text.
    cuts = removed.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_cut_id")).agg(
        F.collect_set(F.struct("signature", "key")).alias("_cuts"))
    marks = good.join(cuts, F.col("_kept_id") == F.col("_cut_id"), "left").select("_kept_id", "_cuts")

    def cut(text: pa.Array, host: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for t, h, c in zip(text, host, cuts):
            t = t.as_py()
            if t is not None and (c := c.as_py()):
                b = t.encode()
                mine = text_key(b)
                keys = {x["key"] for x in c if x["signature"] == mine}
                t = without_lines(b, host_key(h.as_py()), keys).decode() if keys else t
            out.append(t)
        return pa.array(out, pa.string())

    changed = F.col("_cuts").isNotNull()
    # Texts without such lines stay out of the function.
    left = F.arrow_udf(cut, "string")(F.when(changed, docs["text"]), docs["source"], "_cuts")
    out = docs.join(marks, docs["doc_id"] == marks["_kept_id"]).withColumn("_left", left)
    cols = {"text": F.when(changed, F.col("_left")).otherwise(docs["text"])}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(changed & (F.col("_left") != docs["text"]), F.length("_left").cast("long")).otherwise(
            docs["n_chars"])
    return out.select(*[cols.get(c, docs[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir))


_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, t, line, len(regexp_extract_all(line, '{_WORD}')) AS n,
    array_to_string(regexp_extract_all(
      regexp_replace(translate(line, '{_UPPER}', '{_UPPER.lower()}'), '[0-9]', '0', 'g'), '{_WORD}'), ' ') AS normal
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d)),
held AS (SELECT * FROM lines WHERE n > 0),
repeated AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM held GROUP BY doc_id),
frequent AS (SELECT source, normal, arg_min(t, doc_id) AS owner FROM held GROUP BY source, normal
  HAVING count(DISTINCT t) > {LINE_DOCUMENTS}),
gone AS (SELECT h.doc_id, sum(h.n) AS n FROM held h JOIN frequent f
  ON h.source IS NOT DISTINCT FROM f.source AND h.normal = f.normal WHERE h.t <> f.owner GROUP BY h.doc_id),
counts AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(r.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    CAST(len(w) - coalesce(g.n, 0) AS BIGINT) AS n_remaining_words
  FROM d LEFT JOIN repeated r ON r.doc_id = d.doc_id LEFT JOIN covered c ON c.doc_id = d.doc_id
  LEFT JOIN gone g ON g.doc_id = d.doc_id),
ruled AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_SHARE} * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND 100 * n_remaining_words >= {MIN_REMAINING_SHARE} * n_words AS kept FROM ruled"""
