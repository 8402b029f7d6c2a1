"""Operators 1 and 7 and the pipeline against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from vcscope.llm import op1_jaccard, op3_secrets, op7_lines
from .conftest import edge_pairs


def shingle_set(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute_components(pairs, k=4, percent=85):
    sets = [shingle_set(t or "", k) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(pairs):
        least[find(i)].append(d)
    return Counter((d, len(s), min((x for x in least[find(i)] if x is not None), default=None))
                   for i, ((d, _), s) in enumerate(zip(pairs, sets)))


def test_components_on_edges(edge):
    got = Counter(map(tuple, op1_jaccard.components(edge).collect()))
    assert got == brute_components(edge_pairs())


def family_pairs(seed, n=150):
    """Chains and stars of edited texts over shared passages: many similarities
    near the threshold, and documents of different families that share most text."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passages = [rnd.choices(vocab, k=40) for _ in range(4)]
    pairs = []
    while len(pairs) < n:
        text = sum(rnd.sample(passages, rnd.randint(0, 3)), []) + rnd.choices(vocab, k=rnd.randint(2, 40))
        for _ in range(rnd.randint(1, 8)):
            pairs.append((len(pairs) * 7 % 1009, " ".join(text)))
            text = list(text)
            for _ in range(rnd.randint(0, max(1, len(text) // 45))):
                text[rnd.randrange(len(text))] = rnd.choice(vocab)
    return pairs


@pytest.mark.parametrize("seed,pivots", [(1, 256), (2, 256), (4, 2)])
def test_components_near_the_threshold(make, seed, pivots):
    pairs = family_pairs(seed)
    got = Counter(map(tuple, op1_jaccard.components(make(pairs).repartition(4), pivots=pivots).collect()))
    assert got == brute_components(pairs)


def test_components_of_null_ids(spark, make):
    """Rows without doc_id carry links, before or after an equal numbered row, and alone."""
    rnd = random.Random(14)
    words = ["".join(rnd.choices("abcdefgh", k=7)) for _ in range(400)]
    pairs = []
    for i in range(12):
        a = words[30 * i:30 * i + 60]
        if len(a) < 60:
            a = a + rnd.choices(words, k=60 - len(a))
        text = [" ".join(a + [f"x{k}" for k in range(j)]) for j in (0, 4, 8)]
        # The first two and the last two are linked; the null row equals the middle one.
        ids = (100 + 3 * i, 101 + 3 * i if i % 2 else None, 102 + 3 * i)
        pairs += [(None, text[1])] + list(zip(ids, text)) + [(None, text[1])]
    rows = op1_jaccard.components(make(pairs).coalesce(1)).collect()
    assert Counter(map(tuple, rows)) == brute_components(pairs)


def test_components_other_threshold(make):
    pairs = family_pairs(3, 100)
    got = Counter(map(tuple, op1_jaccard.components(make(pairs), 5, 80).collect()))
    assert got == brute_components(pairs, 5, 80)


# -- lines ---------------------------------------------------------------------


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def test_banded_distance():
    rnd = random.Random(2)
    for _ in range(4000):
        a = "".join(rnd.choices("abc", k=rnd.randint(0, 12)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randint(0, len(b))
            b[k:k + rnd.randint(0, 1)] = rnd.choice(["", "a", "d"])
        b = "".join(b)
        for tau in range(4):
            assert op7_lines.edit_distance(a, b, tau) == min(distance(a, b), tau + 1)


def test_segments_meet():
    """Texts at most tau edits apart share an index and a probe key."""
    rnd = random.Random(4)
    for _ in range(500):
        tau = rnd.randint(0, 3)
        a = "".join(rnd.choices("abcdefgh", k=rnd.randint(20, 40)))
        b = list(a)
        for _ in range(tau):
            k = rnd.randint(0, len(b))
            b[k:k + rnd.randint(0, 1)] = rnd.choice(["", "x", "y"])
        b = "".join(b)
        line, key, index, _, _ = op7_lines.segment_keys([a, b], tau, 0)
        owned = [set(key[(line == k) & index].tolist()) for k in (0, 1)]
        all_ = [set(key[line == k].tolist()) for k in (0, 1)]
        assert owned[0] & all_[1] or owned[1] & all_[0]


def brute_drops(pairs, tau=2):
    """For each row (in the order of reading) the numbers of its dropped lines."""
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0] is None, pairs[i][0] or 0, i))
    first, seen = {}, []
    for i in order:
        for n, s in op7_lines.lines_of(pairs[i][1] or ""):
            if s not in first:
                first[s] = (i, n)
                seen.append(s)
    near = {t for k, t in enumerate(seen) for s in seen[:k]
            if abs(len(s) - len(t)) <= tau and distance(s, t) <= tau}
    return Counter((pairs[i][0], tuple(n for n, s in op7_lines.lines_of(pairs[i][1] or "")
                                       if first[s] != (i, n) or s in near)) for i in range(len(pairs)))


def line_pairs(seed, n=40):
    rnd = random.Random(seed)
    lines = ["".join(rnd.choices("abcdef ", k=rnd.randint(19, 40))) for _ in range(60)]
    lines += [f"The price of the item is {i:05d} today" for i in rnd.sample(range(10**5), 120)]
    pairs = []
    for i in range(n):
        text = []
        for s in rnd.sample(lines, 8):
            s = list(s)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                s[rnd.randrange(len(s))] = rnd.choice(["", "q", "zz"])
            text.append("".join(s))
        pairs.append((1000 - i, "\n".join(text)))
    return pairs


@pytest.mark.parametrize("heads, split_over", [(64, 4096), (2, 4)])
def test_dropped_lines(make, heads, split_over):
    pairs = line_pairs(5) + [(None, "a line of the null id, twenty"), (2000, None), (2001, "")]
    got = Counter((r.doc_id, tuple(r.dropped)) for r in
                  op7_lines.dropped_lines(make(pairs).repartition(3), heads=heads, split_over=split_over).collect())
    assert got == brute_drops(pairs)


def test_dropped_lines_on_edges(make):
    pairs = [(i, t) for i, t in edge_pairs() if i not in (None, 5, 100)]
    rows = op7_lines.dropped_lines(make(pairs)).collect()
    assert Counter((r.doc_id, tuple(r.dropped)) for r in rows) == brute_drops(pairs)
    out = op7_lines.deduped(make(pairs))
    drops = {r.doc_id: set(r.dropped) for r in rows}
    want = {}
    for i, t in pairs:
        left = "\n".join(s for n, s in enumerate((t or "").split("\n")) if n not in drops[i])
        if not drops[i]:
            want[i] = t
        elif left.split():
            want[i] = left
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == want and out.columns == make(pairs).columns
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


@pytest.mark.parametrize("heads, split_over", [(64, 4096), (2, 4)])
def test_short_lines(make, heads, split_over):
    """Equal lines of any length go, near ones from tau + 1 characters on."""
    rnd = random.Random(8)
    lines = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 19))) for _ in range(150)]
    pairs = [(i, "\n".join(rnd.choices(lines, k=6))) for i in range(60)]
    seen, want = [], {}
    for i, t in pairs:
        want[i] = []
        for n, s in enumerate(t.split("\n")):
            if s in seen or any(min(len(s), len(x)) > 2 and distance(s, x) <= 2 for x in seen):
                want[i].append(n)
            seen.append(s)
    rows = op7_lines.dropped_lines(make(pairs).repartition(3), heads=heads, split_over=split_over).collect()
    assert {r.doc_id: r.dropped for r in rows} == want
    out = {r.doc_id: r.text for r in op7_lines.deduped(make([(1, "Les.\nab"), (2, "ab\n Les.\ncd"), (3, "Les.")])).collect()}
    assert out == {1: "Les.\nab", 2: "cd"}


def test_repeated_rows_of_lines(edge):
    assert op7_lines.dropped_lines(edge).count() == edge.count()
    assert op7_lines.deduped(edge).columns == edge.columns


def test_deduped_with_repeated_and_null_ids(spark, make):
    """Rows of one doc_id lose their own lines and no others; null ids come last."""
    rnd = random.Random(21)
    lines = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "omega", "sigma"], k=6)) for _ in range(25)]
    pairs = [(i // 3, "\n".join(rnd.choices(lines, k=4) + [f"own {i} of these many words {i * 7919}"])) for i in range(30)]
    pairs += [(1, "a start of its own, long enough\n" + lines[0]), (2, lines[0] + "\nanother wholly different start"),
              (2, "a start of its own, long enoogh\nand what only this row says, seen nowhere else")]
    pairs += [(None, pairs[0][1])] * 2 + [(None, "only a row without an id says this\n" + lines[3])] * 3
    pairs += [(7, "said twice in equal rows, and nowhere else")] * 2 + [(50, ""), (50, ""), (51, None), (51, None), (None, " ")]
    rnd.shuffle(pairs)
    df = make(pairs)
    sig = {r.text: r.sig for r in df.select("text", op7_lines._sig()).collect()}
    rows = sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, sig[p[1]]))
    seen, out, told, before = [], Counter(), set(), None
    for i, t in rows:
        if (i, t) == before and (t or "").split():
            continue  # a repeat has nothing that wasn't said before
        before = (i, t)
        keep = [no for no, s in enumerate((t or "").split("\n")) if not s.strip()]
        for no, s in op7_lines.lines_of(t or ""):
            if s not in told and not any(distance(s, y) <= 2 for y in seen):
                keep.append(no)
            if s not in told:
                told.add(s)
                seen.append(s)
        left = "\n".join(s for no, s in enumerate((t or "").split("\n")) if no in keep)
        if len(keep) == len((t or "").split("\n")):
            out[i, t] += 1
        elif left.strip():
            out[i, left] += 1
    got = op7_lines.deduped(df.repartition(4))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == out
    dropped = op7_lines.dropped_lines(df.repartition(4)).where("doc_id = 7 AND n_lines = 1").collect()
    assert sorted(len(r.dropped) for r in dropped) == [0, 1]


def test_lines_of_a_hot_group(spark, make):
    """Variants of one line in very many documents: rows of a group, not pairs."""
    rnd = random.Random(22)
    base = "the very common line that many documents hold"
    pairs = []
    for i in range(600):
        s = list(base)
        s[rnd.randrange(len(s))] = rnd.choice("xyz")
        pairs.append((i, "".join(s) + f"\n{rnd.randint(0, 10**12)} and {rnd.randint(0, 10**12)}"))
    docs = make(pairs).repartition(3)
    rows = op7_lines.dropped_lines(docs).collect()
    assert {r.doc_id for r in rows if 0 in r.dropped} == set(range(1, 600))
    members = op7_lines._members(op7_lines._packed_keys(docs, 2, 10))
    # Each line is a member once a key: its segments and the starts probed.
    assert members.count() <= 15 * members.select("id").distinct().count()


@pytest.mark.parametrize("op", [op1_jaccard.components, op7_lines.dropped_lines, op7_lines.deduped])
def test_empty_table(none, op):
    assert op(none).count() == 0


# -- pipeline --------------------------------------------------------------------


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns(spark, edge, none, k):
    name, step = corpus_pipeline.STAGES[k]
    assert step(spark, edge, "").columns == edge.columns
    assert step(spark, none, "").count() == 0


def test_pipeline_stages_by_brute_force(spark, make, tmp_path):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choices("abcdefgh", k=7)) for _ in range(2000)]

    def text(n):
        return "\n".join(" ".join(rnd.choices(vocab, k=12)) for _ in range(n))

    clean = [(i, text(8)) for i in range(20)]
    near = clean[3][1].split()
    near[50] = "zzzz"
    # Two lines of a copy in one line each: line dedup can't see them, the join does.
    near = " ".join(near)
    flat = clean[4][1].replace("\n", " ")
    pairs = clean + [(30, clean[2][1]), (31, near), (32, flat), (33, "too short"),
                     (34, text(8) + "\npassword = 'abcdef123'")]
    docs = make(pairs)
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in pairs} - {33}
    lines = corpus_pipeline.line_dedup(spark, kept, "")
    assert {r.doc_id for r in lines.collect()} == {i for i, _ in pairs} - {33, 30}
    one = corpus_pipeline.near_duplicates(spark, lines, "")
    assert {r.doc_id for r in one.collect()} == {i for i, _ in clean} | {34}
    safe = corpus_pipeline.secret_scans(spark, one, "")
    by_id = {r.doc_id: r.text for r in safe.collect()}
    assert by_id[34].endswith(op3_secrets.REDACTED + "'") and all(by_id[i] == t for i, t in clean)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(by_id)
