"""Byte-level BPE encoding and decoding over Arrow batches.

Each match of the tokenizer's pattern is encoded by the ``tokenizers`` library.
Its byte-to-character table spells bytes as printable characters; decoding
reverses the table and gives back the bytes, also where one character is split
over several tokens.

Defined results: a null text counts as empty, an empty text has no ids; a null
doc_id is kept as it is; repeated rows and ties each give their row; an empty
table gives no rows; other columns of the input are not read."""

from __future__ import annotations

import codecs
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import MEMO_ENTRIES, documents, map_arrow, slices


def byte_table() -> dict[str, int]:
    """Printable character → byte of the byte-level alphabet: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(moved)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """id → the bytes its characters stand for."""
    back = byte_table()
    vocab = bpe.load(path, True).get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def decode_bytes(ids, path: str) -> bytes:
    return b"".join(map(token_bytes(path).__getitem__, ids))


def decode_parts(parts, path: str):
    """Text of consecutive lists of ids. A character whose bytes are split over
    two lists comes with the later one; bytes that never complete a character
    become U+FFFD at the end."""
    dec = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in parts:
        yield dec.decode(decode_bytes(ids, path))
    if rest := dec.decode(b"", True):
        yield rest


@lru_cache(maxsize=2)
def _spans(path: str) -> dict:
    return {}


def encode_ids(texts: list[str], path: str) -> list[list[int]]:
    """Ids of each whole text."""
    return [list(chain.from_iterable(parts)) for parts in bpe.byte_ids(path).encode(texts)]


def encode_spans(text: str, path: str) -> tuple[list[int], list[int], list[int]]:
    """Ids with start and end of the characters (code points) each touches.
    Tokens that share a split character all carry that character's span."""
    known, tok = _spans(path), bpe.load(path, True)
    ids, starts, ends, at = [], [], [], 0
    for block in bpe.pieces_of(text):
        if len(known) > MEMO_ENTRIES:
            known.clear()
        new = list(set(block).difference(known))
        for piece, e in zip(new, tok.encode_batch(new, add_special_tokens=False)):
            known[piece] = (e.ids, e.offsets)
        for piece in block:
            got, spans = known[piece]
            ids += got
            starts += [at + a for a, _ in spans]
            ends += [at + b for _, b in spans]
            at += len(piece)
    return ids, starts, ends


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends (arrays): every whole text of ``docs`` encoded."""
    path = path or bpe.tokenizer_path(bpe.BYTE_LEVEL)

    def run(batches):
        for b in slices(batches):
            rows = [encode_spans(t or "", path) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([r[k] for r in rows], pa.list_(pa.int32()))
                                       for k in range(3))],
                ["doc_id", "ids", "starts", "ends"])

    return map_arrow(docs.select("doc_id", "text"), run,
                     "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: the reverse of :func:`encode`."""
    path = path or bpe.tokenizer_path(bpe.BYTE_LEVEL)

    def run(batches):
        for b in batches:
            text = ["".join(decode_parts([ids or []], path)) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())],
                                             ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    path = path or bpe.tokenizer_path(bpe.BYTE_LEVEL)

    def run(batches):
        names = [str(i) for i in range(len(token_bytes(path)))]
        for b in slices(batches):
            n, enc, dec = [], [], []
            for ids in encode_ids([t or "" for t in b.column("text").to_pylist()], path):
                n.append(len(ids))
                enc.append(sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                dec.append(sha256(decode_bytes(ids, path)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
