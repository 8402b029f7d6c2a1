"""Tokenizing operators (2, 8, 9) against the libraries themselves."""

import base64
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from vcscope.llm import bpe, op2_bpe, op8_tokens, op9_packing
from .conftest import edge_pairs

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in
             map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_digests(edge, reference):
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in op2_bpe.digests(edge).collect())
    want = []
    for i, t in edge_pairs():
        ids = reference.encode_ordinary(t or "")
        want.append(((i is None, i or 0), len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_byte_bpe_round_trip_and_spans(edge, reference):
    enc = op2_bpe.encode(edge)
    text = {r.doc_id: r.text for r in op2_bpe.decode(enc).where("doc_id < 50").collect()}
    given = {i: t or "" for i, t in edge_pairs() if i is not None and i < 50}
    assert text == given
    for r in enc.where("doc_id < 50").collect():
        t = given[r.doc_id]
        assert r.ids == reference.encode_ordinary(t)
        assert all(0 <= a < b <= len(t) for a, b in zip(r.starts, r.ends))


def test_split_characters_decode():
    path = bpe.tokenizer_path(bpe.BYTE_LEVEL)
    ids = op2_bpe.encode_ids(["a\U0001d11e汉"], path)[0]
    assert "".join(op2_bpe.decode_parts([[i] for i in ids], path)) == "a\U0001d11e汉"
    assert op2_bpe.decode_bytes(ids, path) == "a\U0001d11e汉".encode()
    assert "".join(op2_bpe.decode_parts([ids[:2]], path)).endswith("�")


def test_long_texts_in_blocks(reference, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 25)
    path = bpe.tokenizer_path(bpe.BYTE_LEVEL)
    texts = [t or "" for _, t in edge_pairs()]
    assert op2_bpe.encode_ids(texts, path) == [reference.encode_ordinary(t) for t in texts]


def test_token_histogram(edge, reference):
    n = np.array(sorted(len(reference.encode_ordinary(t or "")) for _, t in edge_pairs()))
    hist = op8_tokens.histogram(edge).cache()
    for r in hist.collect():
        assert r.n_docs == (n == r.length).sum() and r.n_tokens == n[n == r.length].sum()
        assert r.docs_from == (n >= r.length).sum() and r.tokens_from == n[n >= r.length].sum()
        assert r.tokens_cut_at == np.minimum(n, r.length).sum()
        assert abs(r.share_to - (n <= r.length).mean()) < 1e-12
    assert hist.count() == len(set(n))
    for r in op8_tokens.truncated(hist, [0, 7, 100, 10**6]).collect():
        assert r.tokens_kept == np.minimum(n, r.context_limit).sum()
        assert r.n_docs_cut == (n > r.context_limit).sum()
    assert op8_tokens.quantile(hist, 0.5).first()[0] == n[(len(n) + 1) // 2 - 1]


def check_packing(rows, capacity):
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values(), default=0) <= capacity
    return len(at)


def test_packing(edge):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    rows = op9_packing.packed(edge, group_pieces=20).collect()
    want = Counter()
    for i, t in edge_pairs():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    total = sum(k[3] * n for k, n in want.items())
    assert check_packing(rows, 4096) <= -(-total // 4096) + 1


def test_local_search_empties_bins():
    size = np.array([6, 4, 5, 3, 2])
    bins = op9_packing.local_search([[0], [1, 2], [3, 4]], size, 10)
    assert len(bins) == 2 and sorted(sum(bins, [])) == [0, 1, 2, 3, 4]
    rng = np.random.default_rng(3)
    for high in (10, 60, 100):
        size = rng.integers(1, high, 300)
        before = op9_packing.best_fit(size, 100)
        after = op9_packing.local_search(before, size, 100)
        assert sorted(sum(after, [])) == list(range(300)) and len(after) <= len(before)
        assert max(size[b].sum() for b in after) <= 100


@pytest.mark.parametrize("low, high, n", [(22, 50, 1200), (5, 40, 700), (30, 34, 900), (1, 99, 500), (33, 50, 41)])
def test_local_search_leaves_no_exchange(low, high, n):
    """By brute force over all pairs of underfull bins, of which there are more than 256."""
    size = np.random.default_rng(low).integers(low, high + 1, n)
    bins = op9_packing.local_search(op9_packing.best_fit(size, 100), size, 100)
    assert sorted(sum(bins, [])) == list(range(n)) and max(size[b].sum() for b in bins) <= 100
    if len(bins) == -(-size.sum() // 100):
        return
    fill = [int(size[b].sum()) for b in bins]
    sums = [{0, *size[b].tolist(), *(int(size[i] + size[j]) for k, i in enumerate(b) for j in b[k + 1:])} for b in bins]
    for a in range(len(bins)):
        for b in range(len(bins)):
            if a != b and fill[a] <= fill[b] < 100:
                assert not any(0 < x - y <= 100 - fill[b] for x in sums[a] for y in sums[b])


def test_rounds_reopen_all_underfull_bins(spark):
    """Bins with little free room are packed again too: no more than one sequence is lost."""
    rnd = random.Random(2)
    pairs = [(i, " ".join(rnd.choices("abcdefghij", k=rnd.randint(1, 60)))) for i in range(3000)]
    rows = op9_packing.packed(spark.createDataFrame(pairs, "doc_id long, text string"), 100, group_pieces=60).collect()
    assert check_packing(rows, 100) <= -(-sum(r.length for r in rows) // 100) + 1


@pytest.mark.parametrize("op", [op2_bpe.digests, op2_bpe.encode, op8_tokens.histogram, op9_packing.packed])
def test_empty_table(none, op):
    assert op(none).count() == 0
