"""Word spans of a whole Arrow batch in one pass of a table-driven transducer.

A table maps each byte to its class, a second one a (state, class) pair to the
next state and the marks the step gives out. Word separators reset the state
whatever came before, so the state before a byte is known from the byte before it
(or from the start of a text), and the pass runs over the batch's bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# States: between words, inside a word.
BETWEEN, INSIDE = 0, 1


def batch_bytes(batch: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column one after the other, and the n + 1
    places where its texts begin and end; null is the empty text."""
    col = batch.column(batch.schema.get_field_index(text))
    col = col.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def transitions(classes: np.ndarray, word: int) -> np.ndarray:
    """[state, class] → next state, for classes with the bit ``word`` set in words."""
    inside = (np.arange(256) & word != 0).astype(np.uint8)
    return np.stack([inside, inside])


def states(cls: np.ndarray, table: np.ndarray, starts: np.ndarray, before: int = BETWEEN):
    """State before and after each byte; every text starts between words.
    ``before`` is the state that the bytes go on from."""
    after = table[BETWEEN][cls]
    prev = np.empty_like(after)
    if len(prev):
        prev[0] = before
        prev[1:] = after[:-1]
        prev[starts[starts < len(prev)]] = BETWEEN
    return prev, after


def word_spans(cls: np.ndarray, table: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; ``offsets`` are the texts' places."""
    prev, after = states(cls, table, offsets[:-1])
    begins = np.flatnonzero((prev == BETWEEN) & (after == INSIDE))
    # A word ends before a separator or with its text.
    ends_here = np.empty(len(after), dtype=bool)
    if len(after):
        ends_here[:-1] = after[1:] == BETWEEN
        ends_here[-1] = True
        last = offsets[1:]
        last = last[last > offsets[:-1]] - 1
        ends_here[last] = True
    ends = np.flatnonzero((after == INSIDE) & ends_here) + 1
    return begins, ends


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    places = np.flatnonzero(marks)
    return np.diff(np.searchsorted(places, offsets))


def blocks(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cut the bytes into blocks of about ``size`` that end outside words or
    with a text, longer only where a word is."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + size, n)
        while end < n and is_word[data[end - 1]] and is_word[data[end]]:
            nxt = offsets[np.searchsorted(offsets, end)]
            if nxt == end:
                break
            gap = np.flatnonzero(~is_word[data[end:min(end + size, nxt)]])
            end = end + int(gap[0]) if len(gap) else min(end + size, int(nxt))
        yield at, end
        at = end
