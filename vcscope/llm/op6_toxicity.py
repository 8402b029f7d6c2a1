"""Toxic passages by maximum-scoring segments over token log-odds.

Learning: from at most LEARN_FROM labelled rows outside the held-out fold (all of
them while they are fewer; the least hashes of their ids beyond that), documents
that hold a feature (a word or one of its beginnings) are counted by label. Log-odds with an
informative Dirichlet prior (the feature's share of all counts) are lowered by
two standard errors; what stays positive is a feature's weight. A word weighs as
its weightiest feature, minus a drift that makes ordinary text run downhill.

Scoring: one linear scan finds all maximal segments of positive sum. By
extreme-value theory a clean text of n words holds about K n exp(-lambda s)
segments of score s or more; K and lambda are fitted to the clean learning rows,
so a long text needs a higher score to stand out. The evidence of a document
(its best segment's, raised by further significant ones) is calibrated to a
probability by a logistic curve over a histogram of all learning rows.

Broadcast are the learning rows' labels (at most LEARN_FROM ids) and the weights
(one array of FEATURES, 4 MB); the driver gets those weights that aren't 0 and a
histogram of at most BINS cells by label. Texts are never shuffled.

Defined results: a null text counts as empty and gets the score of no evidence;
null doc_ids are not held out and never learned from, and keep their row;
repeated rows each give their row (labels that contradict each other count as
toxic); without any labelled row every score is 0; an empty table gives no rows;
other columns of the input are not read."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, documents, map_arrow, slices, stage, table, texts_of, word_blocks

FOLDS, HELD_OUT = 4, 2
LEARN_FROM = 200_000
PREDICT_AT = 0.3
FEATURES = 1 << 20
BEGINNINGS = (3, 4, 5, 6, 7)
PRIOR_SHARE = 0.05  # pseudo-documents of the prior, as a share of the feature's documents
PRIOR_LEAST = 0.5
ERRORS = 2.0        # standard errors a weight is lowered by
LEAST_DOCUMENTS = 3
DRIFT = 0.02
# Histogram of evidence for the calibration.
BIN, BINS = 0.5, 240

_EDGES = re.compile(r"^\W+|\W+$")


def features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself and its beginnings, in lower case and
    without punctuation around it."""
    w = _EDGES.sub("", word.decode("utf-8", "replace").lower())
    if not w:
        return ()
    names = {"=" + w} | {f"{w[:k]}*" for k in BEGINNINGS if len(w) >= k}
    return tuple(xxhash.xxh3_64_intdigest(x.encode()) % FEATURES for x in names)


feature_memo = Memo(features)


def feature_counts(labelled: DataFrame) -> DataFrame:
    """feature, toxic, clean: documents that hold each feature."""
    def run(batches):
        counts = np.zeros((2, FEATURES), dtype=np.int64)
        for b in slices(batches):
            for text, toxic in zip(texts_of(b), b.column("toxic").to_pylist()):
                words = set().union(*word_blocks(text))
                held = set().union(*map(feature_memo.__getitem__, words))
                counts[int(toxic), np.fromiter(held, dtype=np.int64, count=len(held))] += 1
        at = np.flatnonzero(counts.any(axis=0))
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(counts[1, at]), pa.array(counts[0, at])],
                ["feature", "toxic", "clean"])

    each = map_arrow(labelled, run, "feature long, toxic long, clean long")
    return each.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_weights(labelled: DataFrame) -> np.ndarray:
    """Weight of each feature, 0 for most."""
    counts = stage(feature_counts(labelled), "toxic-counts")
    n = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    weights = np.zeros(FEATURES, dtype=np.float32)
    if not n["t"] or not n["c"]:
        return weights
    nt, nc = float(n["t"]), float(n["c"])
    prior = F.greatest(F.lit(PRIOR_LEAST), PRIOR_SHARE * (F.col("toxic") + F.col("clean")))
    all_prior = PRIOR_SHARE * (nt + nc)
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(t / F.greatest(nt + all_prior - t, F.lit(1.0))) - F.log(
        c / F.greatest(nc + all_prior - c, F.lit(1.0)))
    weight = odds - ERRORS * F.sqrt(1 / t + 1 / c)
    # The prior keeps c above 0; at most FEATURES rows.
    kept = (counts.where(F.col("toxic") >= LEAST_DOCUMENTS).select("feature", weight.alias("weight"))
            .where("weight > 0").toPandas())
    weights[kept["feature"].to_numpy(dtype=np.int64)] = kept["weight"].to_numpy()
    return weights


def segments(at: np.ndarray, weight: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) of a sequence whose
    words at ``at`` weigh ``weight`` and whose every word loses ``drift``.
    One pass: each new positive word joins the candidates to its left as long as
    that raises the sum; a candidate is looked at once after it is joined."""
    out: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    total, before = 0.0, 0
    for i, w in zip(at.tolist(), weight.tolist()):
        total -= drift * (i - before)
        left, first, end = total, i, i + 1
        total += w - drift
        before = end
        if total <= left:
            continue
        right = total
        while True:
            k = len(out) - 1
            while k >= 0 and out[k][2] >= left:
                k -= 1
            if k < 0 or out[k][3] >= right:
                break
            first, left = out[k][0], out[k][2]
            del out[k:]
        out.append((first, end, left, right))
    return [(a, b, r - s) for a, b, s, r in out]


def scan(docs: DataFrame, weights: np.ndarray, drift: float = DRIFT) -> DataFrame:
    """doc_id, n_words, passages (first word, end word, score): what each text holds."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        memo = Memo(lambda word: max((float(w[f]) for f in features(word)), default=0.0))
        for b in slices(batches):
            n, found = [], []
            for text in texts_of(b):
                at, weight, base = [], [], 0
                for words in word_blocks(text):
                    got = np.fromiter(map(memo.__getitem__, words), dtype=np.float64, count=len(words))
                    hit = np.flatnonzero(got > drift)
                    at.append(hit + base)
                    weight.append(got[hit])
                    base += len(words)
                n.append(base)
                found.append([{"first": a, "end": e, "score": s} for a, e, s in
                              segments(np.concatenate(at), np.concatenate(weight), drift)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.struct(
                    [("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                ["doc_id", "n_words", "passages"])

    return map_arrow(docs.select("doc_id", "text"), run,
                     "doc_id long, n_words long, passages array<struct<first:long,end:long,score:double>>")


def fold() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)),
                      F.lit(-1))


def learning_labels(labels: DataFrame, most: int = LEARN_FROM) -> DataFrame:
    """doc_id, toxic of the rows to learn from, one for each doc_id; at most
    ``most``."""
    marks = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold() != HELD_OUT)
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    marks = stage(marks, "toxic-labels")
    n = marks.count()
    if n > most:
        # A little more than asked for, by hash; then exactly as many.
        parts = 1 << 40
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(parts * min(1.0, 1.1 * most / n)))
        marks = stage(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "toxic-sample")
    return marks


def _logistic(x: np.ndarray, y1: np.ndarray, y0: np.ndarray) -> tuple[float, float]:
    """Slope and intercept over a histogram, by Newton's steps, each halved until
    the (slightly penalised) likelihood doesn't fall."""
    y1, y0 = y1 + 1e-3, y0 + 1e-3

    def loss(v):
        z = v[0] * x + v[1]
        return (y1 * np.logaddexp(0, -z) + y0 * np.logaddexp(0, z)).sum() + 0.05 * (v ** 2).sum()

    v = np.array([0.0, math.log(y1.sum() / y0.sum())])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v[0] * x + v[1], -500, 500)))
        r, w = y1 - (y1 + y0) * p, (y1 + y0) * p * (1 - p)
        g = np.array([(r * x).sum(), r.sum()]) - 0.1 * v
        h = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + 0.1 * np.eye(2)
        step, now = np.linalg.solve(h, g), loss(v)
        while loss(v + step) > now and abs(step).max() > 1e-9:
            step = step / 2
        v = v + step
        if abs(step).max() < 1e-7:
            break
    return float(v[0]), float(v[1])


def scored(docs: DataFrame, labels: DataFrame, learn_from: int = LEARN_FROM) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, passages (the significant ones)."""
    docs = docs.select("doc_id", "text")
    marks = F.broadcast(learning_labels(labels, learn_from))
    labelled = docs.where(fold() != HELD_OUT).join(marks, "doc_id").select("text", "toxic")
    weights = learn_weights(labelled)
    found = stage(scan(docs, weights), "toxic-passages")

    # K and lambda from the segments of clean learning rows.
    known = found.join(marks, "doc_id")
    clean = known.where("toxic = 0").agg(
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.size("passages")), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.expr("aggregate(passages, 0D, (a, p) -> a + p.score)")), F.lit(0.0)).alias("sum")
    ).first()
    lam = (clean["n"] + 1) / (clean["sum"] + 1)
    k = (clean["n"] + 1) / (clean["words"] + 1)

    def evidence():
        log_kn = F.log(F.lit(k) * F.greatest("n_words", F.lit(1)))
        each = F.expr(f"transform(passages, p -> {lam!r} * p.score)")
        return F.coalesce(F.array_max(each) - F.greatest(log_kn, F.lit(0.0))
                          + F.log(F.size("passages").cast("double")), F.lit(-10.0))

    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((evidence() + 20) / BIN))).cast("int")
    hist = known.groupBy(at.alias("bin"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    y = np.zeros((2, BINS))
    for r in hist:
        y[1 if r["toxic"] else 0, r["bin"]] += r["n"]
    if not y[1].sum() or not y[0].sum():
        score = F.lit(0.0)
    else:
        a, b = _logistic((np.arange(BINS) + 0.5) * BIN - 20, y[1], y[0])
        top = (BINS - 0.5) * BIN - 20
        score = 1 / (1 + F.exp(-(F.lit(a) * F.least(evidence(), F.lit(top)) + F.lit(b))))
    limit = F.expr(f"""filter(passages, p -> {lam!r} * p.score > greatest(ln({k!r} * greatest(n_words, 1)), 0D)
                       + 3D)""")  # expected fewer than exp(-3) times in a clean text
    return found.select("doc_id", (fold() == HELD_OUT).alias("held_out"), score.alias("score"),
                        (score >= PREDICT_AT).cast("int").alias("predicted"),
                        "n_words", limit.alias("passages"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
