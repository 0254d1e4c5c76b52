"""Words of whole texts as arrays: their places in the bytes, and 64-bit hashes, without a Python object for each."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes that end a word; A-Z are lower-cased.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SLICE_BYTES = 1 << 20  # of text that are hashed at once

# Each byte's random number, and an odd base for hashes of words as polynomials modulo 2^64.
_VALUES = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_FOLD = np.frombuffer(WORD_TABLE, np.uint8)
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes of all texts, start and end of each word in them, where each text's words start and the end). A null text has none."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    folded = _FOLD[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = folded != 32
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = offsets[(offsets > 0) & (offsets < len(raw))]  # a word ends with its text
    first[cut] = inside[cut + 1]
    last[cut - 1] = inside[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return folded, start, end, np.searchsorted(start, offsets)


def span_hashes(folded: np.ndarray, start: np.ndarray, end: np.ndarray, slice_bytes: int = SLICE_BYTES) -> np.ndarray:
    """64-bit hashes of spans of bytes in order, each a difference of prefix sums of the bytes' numbers times powers of a base, divided by the power at its start."""
    out, a = np.zeros(len(start), np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + slice_bytes, side="right")))
        low, n = int(start[a]), int(end[b - 1] - start[a])
        size = max(slice_bytes, 1 << n.bit_length())
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[folded[low : low + n]] * powers(BASE, size)[:n], out=total[1:])
        s = start[a:b] - low
        out[a:b] = (total[end[a:b] - low] - total[s]) * powers(pow(BASE, -1, 1 << 64), size)[s]
        a = b
    return mixed(out)


def span_bytes(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The spans' bytes, one after the other."""
    size = end - start
    ends = np.cumsum(size)
    return folded[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def grouped_words(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal words together, ascending within each; where the groups start): by hashes, and bytes that prove them equal.

    Should two words share a hash, the bytes themselves are sorted.
    """
    h = span_hashes(folded, start, end)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    groups = np.flatnonzero(new)
    like = np.zeros(len(h), np.int64)
    like[order] = np.repeat(order[groups], np.diff(np.append(groups, len(h))))
    if (end - start == (end - start)[like]).all():
        step = 1 << 16
        if all((span_bytes(folded, start[a : a + step], end[a : a + step]) == span_bytes(folded, start[like[a : a + step]], end[like[a : a + step]])).all() for a in range(0, len(h), step)):
            return order, groups
    words = np.array([folded[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist())], object)
    order = np.array(sorted(range(len(words)), key=lambda i: words[i]), np.int64)
    new[1:] = words[order[1:]] != words[order[:-1]]
    return order, np.flatnonzero(new)


def hashed_words(texts: pa.Array, slice_bytes: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of the texts, where each text's words start and the end). A null text has none."""
    folded, start, end, bounds = word_spans(texts)
    return span_hashes(folded, start, end, slice_bytes), bounds
