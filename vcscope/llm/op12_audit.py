"""Filter interaction audit: what five filters remove in every order of theirs.

A table-driven transducer reads the UTF-8 bytes of a text once. Each step counts
code points, capitals and symbols and follows the state (between words, inside a
word); where a word ends, its span goes into a hash table. Equal hashes are not
trusted: a span that meets an entry of its hash is compared with it byte by byte
and goes on to the next slot if they differ. The table's size is the number of
distinct words. It holds the words of a slice of texts at a time, each under its
text's number, so numpy runs the pass over a whole slice; longer texts than a
slice go through block by block with the same table.

A document is then one 5-bit set of the filters it fails. All counts follow from
the number of documents of each set in each part: what passes every filter of a
prefix of an order is the sum over the sets that miss it.

Failure conditions: A under ``MIN_WORDS`` words, B too few distinct words, C too
many capitals, D a symbol, E the text of a smaller doc_id.

Defined results: a null text counts as empty, a null source as the part ''; a null
doc_id is not smaller than any and nothing is smaller than it, it has no label, and
E never fails it; rows of one doc_id are rows of their own, each counted, and none
is smaller than the other; of several labels of a doc_id the greatest holds; labels
of other ids are not used; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, slices, stage, table
from .spans import batch_bytes, blocks, per_text, transitions, word_spans

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2

# Classes of bytes: bits that a step counts or that decide the state.
WORD, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8


def _classes() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    separators = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
    out[~separators] |= WORD
    out[ord("A"):ord("Z") + 1] |= CAPITAL
    out[list(b"#$%&*|")] |= SYMBOL
    # A continuation byte (10xxxxxx) is no code point of its own.
    out[np.arange(256) & 0xC0 != 0x80] |= POINT
    return out


CLASSES = _classes()
IS_WORD = CLASSES & WORD != 0
NEXT_STATE = transitions(CLASSES, WORD)

_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** i modulo 2 ** 64."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        m = min(done, n - done)
        out[done:done + m] = out[:m] * np.uint64(pow(int(base), done, 1 << 64))
        done += m
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from running sums."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _P), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(len(data) + 1, _INVERSE)[starts]
    h ^= (ends - starts).astype(np.uint64) << np.uint64(47)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes at a equal those at b, pair by pair (n > 0)."""
    out = np.empty(len(a), dtype=bool)
    edges = np.cumsum(n)
    lo = 0
    while lo < len(a):  # about a million bytes at a time
        done = edges[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(edges, done + (1 << 20), side="right")))
        m = n[lo:hi]
        first = np.cumsum(m) - m
        within = np.arange(int(m.sum()), dtype=np.int64) - np.repeat(first, m)
        differ = data[np.repeat(a[lo:hi], m) + within] != data[np.repeat(b[lo:hi], m) + within]
        out[lo:hi] = np.add.reduceat(differ, first) == 0
        lo = hi
    return out


class SpanTable:
    """Open-addressing table of the distinct (text, word) spans of ``data``."""

    def __init__(self, data: np.ndarray, texts: int):
        self.data = data
        self.texts = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.slots = np.full(16, -1, dtype=np.int64)
        self.distinct = np.zeros(texts, dtype=np.int64)

    def _grown(self, n: int) -> None:
        """At least twice as many slots as entries; entries keep their numbers."""
        size = len(self.slots)
        if 2 * n <= size:
            return
        while 2 * n > size:
            size *= 2
        self.slots = np.full(size, -1, dtype=np.int64)
        todo = np.arange(len(self.starts))
        slot = (self.hashes >> np.uint64(3)).astype(np.int64) & (size - 1)
        while len(todo):  # all entries are distinct: only free slots count
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & (size - 1)

    def insert(self, texts: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        base = len(self.starts)
        self._grown(base + len(starts))
        t = np.concatenate([self.texts, texts])
        s = np.concatenate([self.starts, starts])
        n = np.concatenate([self.lengths, ends - starts])
        # A text's number is part of the hash.
        h = np.concatenate([self.hashes, (hashes + texts.astype(np.uint64) * _P) * _MIX])
        size = len(self.slots)
        todo = np.arange(base, len(s))
        slot = (h[todo] >> np.uint64(3)).astype(np.int64) & (size - 1)
        entry = np.zeros(len(s), dtype=bool)
        entry[:base] = True
        while len(todo):
            held = self.slots[slot]
            free = held < 0
            # Several spans may want one free slot: one of them gets it.
            self.slots[slot[free]] = todo[free]
            held = self.slots[slot]
            won = held == todo
            entry[todo[won]] = True
            alike = ~won & (h[held] == h[todo]) & (t[held] == t[todo]) & (n[held] == n[todo])
            pairs = np.flatnonzero(alike)
            alike[pairs] = same_bytes(self.data, s[held[pairs]], s[todo[pairs]], n[todo[pairs]])
            left = ~won & ~alike
            todo, slot = todo[left], (slot[left] + 1) & (size - 1)
        new = np.flatnonzero(entry)
        number = np.cumsum(entry) - 1
        taken = self.slots >= 0
        self.slots[taken] = number[self.slots[taken]]
        self.texts, self.starts, self.lengths, self.hashes = t[new], s[new], n[new], h[new]
        self.distinct += np.bincount(texts[entry[base:]], minlength=len(self.distinct))


def measure(data: np.ndarray, offsets: np.ndarray, block: int = 4 << 20) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points, symbols of each text."""
    n = len(offsets) - 1
    out = {k: np.zeros(n, dtype=np.int64) for k in ("words", "capitals", "points", "symbols")}
    seen = SpanTable(data, n)
    for lo, hi in blocks(data, offsets, IS_WORD, block):
        part = data[lo:hi]
        cls = CLASSES[part]
        first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
        at = np.clip(offsets[first:last + 1] - lo, 0, hi - lo)
        for name, bit in (("capitals", CAPITAL), ("points", POINT), ("symbols", SYMBOL)):
            out[name][first:last] += per_text(cls & bit, at)
        starts, ends = word_spans(cls, NEXT_STATE, at)
        texts = np.searchsorted(at, starts, "right") - 1 + first
        out["words"] += np.bincount(texts, minlength=n)
        seen.insert(texts, starts + lo, ends + lo, span_hashes(part, starts, ends))
    return out | {"distinct": seen.distinct}


COUNTS = "doc_id long, part string, digest binary, failed int"


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, failed: bit i for the i-th of A to D."""
    def run(batches):
        for b in slices(batches):
            data, offsets = batch_bytes(b)
            m = measure(data, offsets)
            failed = ((m["words"] < MIN_WORDS)
                      | (100 * m["distinct"] < MIN_DISTINCT_PERCENT * m["words"]) << 1
                      | (100 * m["capitals"] > MAX_CAPITAL_PERCENT * m["points"]) << 2
                      | (m["symbols"] > 0) << 3)
            view = memoryview(data)
            digest = [hashlib.sha256(view[s:e]).digest() for s, e in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array(digest, pa.binary()),
                 pa.array(failed.astype(np.int32))], ["doc_id", "part", "digest", "failed"])

    return map_arrow(docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part")), run, COUNTS)


def with_copies(rows: DataFrame) -> DataFrame:
    """``failed`` with the bit of E. A text's smallest doc_id comes from map-side
    aggregation, and rows meet it under (digest, doc_id), which no group of
    copies shares."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn(
        "_first", F.lit(True))
    numbered = rows.where("doc_id IS NOT NULL").join(first, ["digest", "doc_id"], "left")
    bit = F.when(F.col("_first").isNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    return numbered.select("doc_id", "part", F.col("failed").bitwiseOR(bit).alias("failed")).unionByName(
        rows.where("doc_id IS NULL").select("doc_id", "part", "failed"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed, good, toxic, n: rows of one doc_id and set counted first."""
    n = rows.groupBy("doc_id", "part", "failed").agg(F.count(F.lit(1)).alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_of")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    zero = F.lit(0)
    joined = n.where("doc_id IS NOT NULL").join(known, F.col("doc_id") == F.col("_of"), "left").select(
        "part", "failed", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"), "n")
    return joined.unionByName(n.where("doc_id IS NULL").select(
        "part", "failed", zero.alias("good"), zero.alias("toxic"), "n"))


def _prefix_bits(order: str, step: str) -> str:
    """SQL: the set of the first ``step`` filters of an order."""
    return " + ".join(f"IF(instr(substring({order}, 1, {step}), '{f}') > 0, {1 << i}, 0)"
                      for i, f in enumerate(FILTERS))


def _share(f: str) -> str:
    """SQL: over all orders, what the filter of bit ``f`` removes: it comes right after
    each set of the others in (size)! * (4 - size)! orders."""
    weight = "element_at(array(24, 6, 4, 6, 24), CAST(bit_count(s) AS int) + 1)"
    return (f"aggregate(filter(sequence(0, 31), s -> (s & {f}) = 0), 0L, (a, s) -> a + "
            f"{weight} * (passed[s] - passed[s | {f}]))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order."""
    rows = stage(failures(docs), "audit")
    sets = with_labels(with_copies(rows), labels).groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"))

    def passing(what: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("failed").bitwiseAND(F.lit(s)) == 0, F.col(what)).otherwise(F.lit(0)))
                         for s in range(1 << len(FILTERS))])

    # passed[s]: documents of the part that no filter of the set s fails.
    parts = sets.groupBy("part").agg(
        passing("n").alias("passed"), passing("good").alias("good"), passing("toxic").alias("toxic"),
        F.array(*[F.sum(F.when(F.col("failed") == F.lit(1 << i), F.col("n")).otherwise(F.lit(0)))
                  for i in range(len(FILTERS))]).alias("only"))
    parts = parts.withColumn("shapley", F.expr(f"transform(sequence(0, 4), i -> {_share('shiftleft(1, i)')})"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.expr("sequence(1, 5)")))
    steps = steps.withColumns({
        "before": F.expr(_prefix_bits("filter_order", "step - 1")),
        "after": F.expr(_prefix_bits("filter_order", "step")),
        "nth": F.expr(f"instr('{FILTERS}', substring(filter_order, step, 1)) - 1")})
    removed = F.expr("passed[before] - passed[after]")
    return steps.select(
        "part", "filter_order", "step", F.expr("passed[after]").alias("kept"), removed.alias("removed"),
        (F.expr("passed[0] - passed[shiftleft(1, nth)]") - removed).alias("redundant"),
        F.expr("only[nth]").alias("unique_fails"), F.expr("good[before] - good[after]").alias("good_lost"),
        F.expr("toxic[before] - toxic[after]").alias("toxic_lost"), F.expr("shapley[nth]").alias("shapley"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


_W = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = rf"""WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
  max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
tests AS (SELECT d.doc_id, part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
    map {{'A': len(w) < {MIN_WORDS},
      'B': 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w),
      'C': 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > {MAX_CAPITAL_PERCENT} * length(d.t),
      'D': regexp_matches(d.t, '[#$%&*|]'),
      'E': coalesce(f.first_id < d.doc_id, false)}} AS fails
  FROM d JOIN firsts f ON d.t = f.t LEFT JOIN known k ON k.doc_id = d.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || e.f || g.f AS filter_order FROM letters a, letters b, letters c, letters e, letters g
  WHERE len(list_distinct([a.f, b.f, c.f, e.f, g.f])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
classes AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM tests GROUP BY part, fails),
judged AS (SELECT c.part, s.filter_order, s.step, s.f, c.n, c.good, c.toxic, c.fails[s.f] AS bad,
    len(list_filter(string_split(s.before, ''), lambda x: c.fails[x])) > 0 AS gone,
    len(list_filter(map_values(c.fails), lambda x: x)) AS failed FROM classes c, steps s),
counted AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT bad), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE NOT gone AND bad), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND bad), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE bad AND failed = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND bad), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE NOT gone AND bad), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted"""
