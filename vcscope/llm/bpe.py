"""Encoders built on the ``tokenizers`` library, one instance per process.

Pieces repeat far more often than texts do, so each distinct piece is encoded
once per slice and looked up after that."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import regex

from .common import MEMO_ENTRIES, word_blocks

BYTE_LEVEL = "byte_bpe_50k.json"
WORD_LEVEL = "word_bpe_49k.json"
# Longer texts are matched in blocks of this many pieces.
BLOCK_CHARS, BLOCK_PIECES = 4 << 20, 1 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def load(path: str, whole_pieces: bool):
    """A Tokenizer; ``whole_pieces``: each input is one match of the pattern."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    if whole_pieces:
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return t


class Pieces:
    """Remembers ``piece → make(ids)`` of the pieces seen of late: when the
    newer half is full, it becomes the older half, which is asked before the
    tokenizer is. ``many`` gives the ids of a list of new pieces."""

    def __init__(self, many, make, entries: int = MEMO_ENTRIES):
        self.many, self.make, self.entries = many, make, entries
        self.known: dict = {}
        self.older: dict = {}

    def learn(self, pieces: Iterable) -> dict:
        """A map that holds all ``pieces``."""
        wanted = set(pieces)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > self.entries:
            self.older, self.known, new = self.known, {}, wanted
        known, older = self.known, self.older
        ask = []
        for p in new:
            if p in older:
                known[p] = older[p]
            else:
                ask.append(p)
        for at in range(0, len(ask), 4096):
            part = ask[at:at + 4096]
            for p, ids in zip(part, self.many(part)):
                known[p] = self.make(ids)
        return known


def _by_library(path: str, whole_pieces: bool):
    """Ids of each of many pieces, encoded by the library in one call."""
    def many(pieces: list) -> list[list[int]]:
        e = load(path, whole_pieces).encode(
            [p.decode() if isinstance(p, bytes) else p for p in pieces],
            is_pretokenized=True, add_special_tokens=False)
        out: list[list[int]] = [[] for _ in pieces]
        for i, w in zip(e.ids, e.word_ids):
            out[w].append(i)
        return out
    return many


@lru_cache(maxsize=1)
def byte_pattern():
    import public_tokenizers
    return regex.compile(public_tokenizers.PATTERN)


def pieces_of(text: str) -> Iterator[list[str]]:
    """Matches of the byte-level pattern, in lists of bounded size."""
    pat = byte_pattern()
    if len(text) <= BLOCK_CHARS:
        yield pat.findall(text)
        return
    found = (m.group() for m in pat.finditer(text))
    while block := list(islice(found, BLOCK_PIECES)):
        yield block


# A space between two characters that aren't white space starts a match, and no
# match goes over it: what such spaces part can be encoded apart.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r" \s|\s ")


def parts_of(text: str) -> Iterator[tuple[str, list[str]]]:
    """(head, tail) of bounded stretches of a text; each part of the tail stands
    for itself after a space, the head for itself."""
    start, head = 0, True
    while True:
        end = len(text)
        if end - start > BLOCK_CHARS and (m := _CUT.search(text, start + BLOCK_CHARS)):
            end = m.start()
        block = text[start:end] if start or end < len(text) else text
        parts = _CUT.split(block) if _DOUBLE.search(block) else block.split(" ")
        yield (parts[0], parts[1:]) if head else ("", parts)
        if end == len(text):
            return
        start, head = end + 1, False


class ByteLevel:
    """``make`` of the ids of whole texts, in order, as lists of remembered parts."""

    def __init__(self, path: str, make):
        pieces = Pieces(_by_library(path, True), tuple)

        def many(parts: list[str]) -> list[list[int]]:
            found = [byte_pattern().findall(p) for p in parts]
            known = pieces.learn(chain.from_iterable(found))
            return [list(chain.from_iterable(map(known.__getitem__, f))) for f in found]

        self.heads, self.make = many, make
        self.tails = Pieces(lambda parts: many([" " + p for p in parts]), make)

    def encode(self, texts: list[str]) -> Iterator[Iterator]:
        """For each text the ``make`` values that follow one another."""
        whole = [next(parts_of(t)) if len(t) <= BLOCK_CHARS else None for t in texts]
        known = self.tails.learn(chain.from_iterable(w[1] for w in whole if w))
        heads = iter(self.heads([w[0] for w in whole if w]))
        for t, w in zip(texts, whole):
            if w:
                yield chain((self.make(next(heads)),), map(known.__getitem__, w[1]))
            else:
                yield self._blocks(t)

    def _blocks(self, text: str) -> Iterator:
        for head, tail in parts_of(text):
            yield self.make(self.heads([head])[0])
            yield from map(self.tails.learn(tail).__getitem__, tail)


@lru_cache(maxsize=2)
def byte_counts(path: str) -> ByteLevel:
    return ByteLevel(path, len)


@lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteLevel:
    return ByteLevel(path, tuple)


def word_ids(path: str) -> Pieces:
    """For one task: a worker holds none of its words while it runs other tasks."""
    return Pieces(_by_library(path, False), lambda ids: np.array(ids, dtype="<u4").tobytes())


def id_bytes(text: bytes, memo: Pieces) -> bytes:
    """Little-endian unsigned 32-bit ids of a whole text by the word-level
    vocabulary. It drops white space and never joins over it, so words that
    ASCII white space parts are encoded apart."""
    return b"".join(chain.from_iterable(
        map(memo.learn(words).__getitem__, words) for words in word_blocks(text)))


def id_bytes_many(texts: list[bytes], memo: Pieces) -> list[bytes]:
    """As :func:`id_bytes` for the texts of a slice, learning their words at once."""
    small = [t.split() if len(t) <= 8 << 20 else None for t in texts]
    known = memo.learn(chain.from_iterable(w for w in small if w))
    out = [b"".join(map(known.__getitem__, w)) if w is not None else None for w in small]
    return [id_bytes(t, memo) if o is None else o for t, o in zip(texts, out)]
