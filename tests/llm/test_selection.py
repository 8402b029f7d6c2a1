"""Operators 11, 12 and 13 against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from vcscope.llm import op11_exact, op12_audit, op13_resampling
from vcscope.llm.spans import batch_bytes
from .conftest import edge_pairs, rows_of

LAST = 1 << 63


def rows_with_sources(pairs):
    return [(r[0], r[1], r[3]) for r in rows_of(pairs)]


# -- exact dedup -------------------------------------------------------------

def brute_dedup(pairs):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(pairs):
        s = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups[hashlib.sha256(s.encode()).hexdigest()].append((-len(t or ""), LAST if i is None else i, i))
    out = Counter()
    for digest, rows in groups.items():
        best = min(rows)
        stayed = False
        for r in sorted(rows, key=lambda x: x[:2]):
            kept, stayed = (not stayed and r[:2] == best[:2]), True
            out[r[2], best[2], len(rows), kept, digest] += 1
    return out


def got_dedup(df, **kw):
    return Counter(tuple(r) for r in op11_exact.marked(df, **kw).collect())


@pytest.mark.parametrize("counters", [4096, 8])
def test_exact_dedup(edge, counters):
    assert got_dedup(edge, counters=counters) == brute_dedup(edge_pairs())


def copies(n=3000):
    """A third of the rows hold one text in several spacings; others have few copies or none."""
    rnd = random.Random(5)
    pairs = [(i, "a hot text" + " " * rnd.randint(0, 3)) for i in range(n // 3)]
    pairs += [(None, "a hot  text")] * 3 + [(7, "a hot text   ")] * 2
    return pairs + [(i, f"text {rnd.randint(0, n)}") for i in range(n // 3, n)]


@pytest.mark.parametrize("counters", [4096, 64, 8])
def test_exact_dedup_of_a_hot_text(make, counters):
    pairs = copies()
    docs = make(pairs).repartition(7)
    assert got_dedup(docs, counters=counters) == brute_dedup(pairs)


def test_frequent_digests_are_verified(make):
    rows = op11_exact.digests(make(copies()).repartition(5))
    heavy = op11_exact.frequent(rows, 64).collect()
    assert [r.group_size for r in heavy] == [1005]
    assert op11_exact.candidates(rows, 64).count() <= 64
    # With a counter for each digest, rare ones are candidates but not frequent.
    assert op11_exact.candidates(rows).count() > 1
    assert all(r.group_size > 1 for r in op11_exact.frequent(rows).collect())


# -- filter audit ------------------------------------------------------------

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counts_of(t):
    w = WORDS.findall(t)
    return len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))


def measured(texts, block=4 << 20):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    m = op12_audit.measure(*batch_bytes(batch), block)
    return list(zip(*(m[k].tolist() for k in ("words", "distinct", "capitals", "points", "symbols"))))


@pytest.mark.parametrize("block", [4 << 20, 64, 7, 1])
def test_transducer(block):
    texts = [t for _, t in edge_pairs() if block > 7 or len(t or "") < 2000]
    texts += ["", None, " a", "a ", "é É\U0001d11e A", "same same same\tsame", "#", "x" * 50]
    assert measured(texts, block) == [counts_of(t or "") for t in texts]


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(op12_audit, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    texts = ["a b c a bb b", "a b", "", "ab ba ab aab " * 5]
    assert measured(texts, 10) == [counts_of(t) for t in texts]


def test_slices_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a b", None, "B  c é", "d"])})
    data, offsets = batch_bytes(batch.slice(1, 2))
    assert data.tobytes().decode() == "B  c é" and offsets.tolist() == [0, 0, 7]


def brute_audit(rows, labels):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", LAST), i)
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    docs = defaultdict(list)
    for i, t, part in rows:
        n, distinct, capitals, points, symbols = counts_of(t or "")
        fails = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * points, "D": symbols > 0,
                 "E": i is not None and smallest[t or ""] < i}
        docs[part or ""].append((fails, i in good, i in toxic))
    out, removed_by = {}, Counter()
    for part, all_ in docs.items():
        for order in permutations("ABCDE"):
            left = all_
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                removed_by[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(d[0][f] for d in all_) - len(gone),
                    sum(d[0][f] and sum(d[0].values()) == 1 for d in all_),
                    sum(d[1] for d in gone), sum(d[2] for d in gone)]
    return {k: tuple(v) + (removed_by[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def audited(spark, docs, labels):
    got = op12_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = got.collect()
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                           "good_lost", "toxic_lost", "shapley"]
    out = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit(spark, edge):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 260, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None), (99999, 1, 1)]
    assert audited(spark, edge, labels) == brute_audit(rows_with_sources(edge_pairs()), labels)


def test_audit_of_many_copies(spark, make):
    rnd = random.Random(3)
    varied = " ".join(f"w{i}" for i in range(250))
    text = [varied, varied.upper(), varied + " #", "one " * 300, "short", "A B", None]
    pairs = [(i, text[0] if i % 3 == 0 else rnd.choice(text)) for i in range(400)]
    pairs += [(None, text[0])] * 3 + [(0, text[0]), (0, text[2]), (3, text[0])]
    labels = [(i, rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(0, 400, 3)]
    assert audited(spark, make(pairs).repartition(5), labels) == brute_audit(rows_with_sources(pairs), labels)


# -- importance resampling ---------------------------------------------------

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features_of(t):
    w = FEATURE.findall((t or "").translate(LOWER))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def test_features_by_block():
    texts = [t for _, t in edge_pairs()] + ["A-b_C d1é", "x" * 300 + " y " + "z" * 400, "a " + "b" * 256 + " " + "c" * 257]
    data, offsets = batch_bytes(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}))
    for block in (4 << 20, 997, 50):
        got = [Counter() for _ in texts]
        for t1, one, t2, two in op13_resampling.features(data, offsets, block):
            for t, b in zip(np.concatenate([t1, t2]).tolist(), np.concatenate([one, two]).tolist()):
                got[t][b] += 1
        assert got == [Counter(features_of(t)[1]) for t in texts]


def brute_resampling(pairs, target, percent=25):
    s, t = Counter(), Counter()
    for _, x in pairs:
        s.update(features_of(x)[1])
    for x in target:
        t.update(features_of(x)[1])
    total_s, total_t = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((n + 1) * (total_t + 10000))))
            for b, n in s.items()}
    rows = []
    for i, x in pairs:
        n, f = features_of(x)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], LAST if r[0] is None else r[0]))
    drawn = [(*r[:4], k) for k, r in enumerate(able[:percent * len(able) // 100], 1)]
    return Counter(tuple(r[:4]) for r in rows), drawn


@pytest.mark.parametrize("percent", [25, 100, 0, 3])
def test_resampling(spark, edge, percent):
    target = [edge_pairs()[9][1], "x y z", None, ""]
    got = op13_resampling.resampled(edge, spark.createDataFrame([(t,) for t in target], "text string"), percent)
    rows = [tuple(r) for r in got.collect()]
    want, drawn = brute_resampling(edge_pairs(), target, percent)
    assert Counter(r[:4] for r in rows) == want
    ranked = sorted((r for r in rows if r[4] is not None), key=lambda r: r[4])
    # Rows of one doc_id and score may change places.
    assert [r[4] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r[3], r[0]) for r in ranked] == [(r[3], r[0]) for r in drawn]


def test_cut_within_ties(spark):
    rows = spark.createDataFrame(
        [(5, i % 4, i) for i in range(40)] + [(9, 100 + i, 100 + i) for i in range(3)] + [(-7, (1 << 63) - 1, 200)],
        "score long, place long, row long")
    order = sorted(map(tuple, rows.collect()), key=lambda r: (-r[0], r[1], r[2]))
    for wanted in (0, 1, 3, 4, 12, 13, 14, 43, 44):
        got = {tuple(r) for r in rows.where(op13_resampling.reaches(rows, wanted)).collect()}
        assert got == set(order[:wanted])


def test_resampling_without_target(spark, make, none):
    docs = make([(1, "a b c " * 10), (2, None), (3, "...")])
    rows = {r.doc_id: r for r in op13_resampling.resampled(docs, spark.createDataFrame([], "text string"), 100).collect()}
    assert rows[1].rank == 1 and rows[1].n_features == 59 and rows[2].weight == rows[3].n_features == 0
    assert rows[2].rank is None


def test_empty_tables(spark, none):
    assert op11_exact.marked(none).count() == 0
    assert op12_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert op13_resampling.resampled(none, spark.createDataFrame([], "text string")).count() == 0
