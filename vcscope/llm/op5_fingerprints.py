"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a bag of word pairs, each weighted by how often it occurs. For every
sample k a pair draws r and c from Gamma(2, 1) and b from (0, 1), all from hashes
of the pair and k; with t = floor(ln w / r + b) its value is
ln a = ln c - r (t - b) - r, and the sample is the (pair, t) of least value. Two
texts agree on a sample with the probability of their generalised Jaccard
similarity, the sum of least over the sum of greatest weights.

The next document (descending doc_id) reaches its predecessor within segments of
the id range; the first document of each segment is also sent to the segment
before, so that no sort sees more than a segment and every text moves once.

Defined results: a null text counts as empty; an empty text has no pairs and the
fingerprint of only zeros, equal to other empty ones alone; a text of one word
has that word as its pair; null doc_ids come last; rows of one doc_id follow each
other by the hash of their text, the greatest first; a single row is its own next document; an empty
table gives no rows; other columns of the input are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, null_text, shuffle_partitions

SAMPLES = 16
SEGMENTS_PER_PARTITION = 4
_LOW = 0xFFFFFFFF
# Values lie within 128 of 0 and are compared at 23 bits after the point.
_SCALE, _SHIFT = float(1 << 23), 128.0


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def pairs_of(words: str) -> str:
    """SQL: hashes of the word pairs; of the word itself where there is but one."""
    return f"""CASE WHEN size({words}) > 1
        THEN transform(sequence(1, size({words}) - 1), i -> xxhash64({words}[i - 1], {words}[i]))
        ELSE transform({words}, w -> xxhash64(w)) END"""


def sample(k: int, weight: str) -> Column:
    """SQL: the value of sample ``k`` in the high and the hash of (pair, t) in the
    low half of a long; ``weight`` names the weight's logarithm (null: absent,
    and so the value). Nothing is conditional, so that the draws, which all weights
    of a row share, are computed once."""
    bits = (1 << 21) - 1
    unit = f"((({{h}} >> {{s}}) & {bits}) + 0.5D) / {float(1 << 21)!r}D"
    h, g = f"xxhash64(term, {k})", f"xxhash64(term, {k}, 1)"
    r = f"(-ln({unit.format(h=h, s=0)} * {unit.format(h=h, s=21)}))"
    b = f"({unit.format(h=h, s=42)})"
    ln_c = f"ln(-ln({unit.format(h=g, s=0)} * {unit.format(h=g, s=21)}))"
    t = f"floor({weight} / {r} + {b})"
    value = f"({ln_c} - {r} * ({t} - {b}) - {r})"
    scaled = f"CAST(({value} + {_SHIFT!r}D) * {_SCALE!r}D AS BIGINT)"
    return F.expr(f"shiftleft({scaled}, 32) | (xxhash64(term, {k}, {t}) & {_LOW}L)")


def signature(bags: DataFrame, keys: list[str], samples: int, weights: dict[str, str]) -> DataFrame:
    """keys and one array of ``samples`` longs for each weight (name → column)
    of rows (keys, term, weights as logarithms)."""
    mins = [F.min(sample(k, w)).alias(f"{name}_{k}") for name, w in weights.items() for k in range(samples)]
    return bags.groupBy(*keys).agg(*mins).select(
        *keys, *[F.array(*[(F.col(f"{name}_{k}").bitwiseAND(F.lit(_LOW))) for k in range(samples)]).alias(name)
                 for name in weights])


def likeness(a: str, b: str, samples: int) -> Column:
    """Share of samples that agree; of two empty texts all do."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x <=> y AS INT)), 0, (s, x) -> s + x) / {float(samples)!r}D")


def text_of(array: str) -> Column:
    return F.array_join(F.transform(array, lambda x: F.lpad(F.hex(F.coalesce(x, F.lit(0).cast("long"))), 8, "0")), "")


def with_next(docs: DataFrame) -> DataFrame:
    """seg, nth, doc_id, text, next_text, guest: every document beside the next
    one in descending doc_id (after the last: the first). Guests are the copies
    of the following segment's first documents and have no next text."""
    spark = docs.sparkSession
    n = SEGMENTS_PER_PARTITION * shuffle_partitions(spark)
    # Nulls go below every id; bounds are as many as segments.
    # Texts tell rows of one doc_id apart, so that many of them are many segments.
    row = docs.select("doc_id", null_text().alias("text"), F.struct(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64(null_text()).alias("tie")).alias("place"))
    tops = [tuple(r["top"]) for r in row.select("place").repartitionByRange(n, F.desc("place"))
            .groupBy(F.spark_partition_id()).agg(F.max("place").alias("top")).collect()]
    tops = sorted(tops, reverse=True) or [(0, 0)]
    # Two steps of lookup: a block of bounds, then within it.
    size = max(1, int(len(tops) ** 0.5))
    blocks = [tops[i:i + size] for i in range(0, len(tops), size)]

    def bounds(rows: list[tuple]) -> Column:
        return F.arrays_zip(F.lit([r[0] for r in rows]).alias("id"), F.lit([r[1] for r in rows]).alias("tie"))

    heads, lists = bounds([b[0] for b in blocks]), bounds(tops)
    row = row.withColumn("block", F.size(F.filter(heads, lambda x: x >= F.col("place"))) - 1)
    row = row.withColumn("seg", F.col("block") * size + F.size(F.filter(
        F.slice(lists, F.col("block") * size + 1, size), lambda x: x >= F.col("place"))) - 1)
    first = F.element_at(lists, F.col("seg") + 1) == F.col("place")
    before = F.pmod(F.col("seg") - 1, F.lit(len(tops)))
    where = F.when(first, F.array(F.struct("seg", F.lit(0).alias("guest")),
                                  F.struct(before.alias("seg"), F.lit(1).alias("guest")))).otherwise(
        F.array(F.struct("seg", F.lit(0).alias("guest"))))
    row = row.select("doc_id", "text", "place", F.explode(where).alias("at")).select(
        "at.seg", "at.guest", "doc_id", "place", "text")
    order = Window.partitionBy("seg").orderBy("guest", F.desc("place"))
    return row.repartition(n, "seg").select(
        "seg", F.row_number().over(order).alias("nth"), "doc_id", "guest", "text",
        F.lead("text").over(order).alias("next_text"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next."""
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    kept = F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 3) AS INT))")
    given = F.expr("substring(next_text, 1, CAST(floor(length(text) / 3) AS INT))")
    base = with_next(docs).withColumn("edited", F.concat(kept, F.coalesce(given, F.lit(""))))
    info = base.where("guest = 0").select(
        "seg", "nth", "doc_id", n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))

    # Pairs before the cut belong to both texts: 3; to the text alone: 1; to the
    # edited text alone: 2 (in the two low bits of the pair's hash).
    # (doc_id goes along so that both branches read one and the same exchange.)
    split = base.select("seg", "nth", "doc_id", words_of(F.col("text")).alias("w"), words_of(F.col("edited")).alias("v"),
                        F.greatest(F.size(words_of(kept)) - 2, F.lit(0)).alias("shared"))
    split = split.select("seg", "nth", "doc_id", "shared", F.expr(pairs_of("w")).alias("p"), F.expr(pairs_of("v")).alias("q"))
    both = F.expr("""concat(
        transform(slice(p, 1, shared), x -> (x & -4L) | 3L),
        transform(slice(p, shared + 1, size(p)), x -> (x & -4L) | 1L),
        transform(slice(q, shared + 1, size(q)), x -> (x & -4L) | 2L))""")
    bags = (split.select("seg", "nth", "doc_id", F.explode_outer(both).alias("x"))
            .groupBy("seg", "nth", "doc_id", F.expr("x & -4L").alias("term"))
            .agg(F.sum(F.expr("x & 1L")).alias("a"), F.sum(F.expr("(x >> 1) & 1L")).alias("b")))
    logs = bags.select("seg", "nth", "term", F.expr("ln(nullif(a, 0L))").alias("la"),
                       F.expr("ln(nullif(b, 0L))").alias("lb"))
    sig = signature(logs, ["seg", "nth"], samples, {"own": "la", "new": "lb"})
    sig = sig.withColumn("next", F.lead("own").over(Window.partitionBy("seg").orderBy("nth")))
    return info.join(sig, ["seg", "nth"]).select(
        "doc_id", "n_chars", "edited_sha256", text_of("own").alias("fingerprint"),
        text_of("new").alias("edited_fingerprint"), likeness("own", "new", samples).alias("near_edited"),
        likeness("own", "next", samples).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
