"""Vectorised hashes of words and shingles, straight from Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Words of a shingle.
SHINGLE = 5
#: Bytes of text hashed together: bounds a task's arrays (a longer text is a slice of its own).
SLICEBYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
BYTES = np.random.default_rng(17).integers(1, 2**64 - 1, 256, np.uint64)
_PLACES = np.random.default_rng(18).integers(1, 2**64 - 1, SHINGLE, np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    a, b = _powers(size)
    return a[:n], b[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with (P[e] - P[s]) * inverse[s] a hash of bytes s to e (to be mixed)."""
    p = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTES[buf] * powers(len(buf))[0], out=p[1:])
    return p


def text_slices(column, size: int = SLICEBYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, n + 1 offsets into them) of slices (of ``size`` bytes, or one longer text) of an Arrow string column without nulls."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        last = min(last, len(column))
        yield first, buf[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end and hash of each word, words of each text); no word crosses the end of a text."""
    if not len(buf):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = ~_SPACES[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    p = prefix_hash(buf)
    with np.errstate(over="ignore"):
        h = mix((p[ends] - p[starts]) * powers(len(buf))[1][starts])
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, ends, h, counts


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text)."""
    return word_bounds(buf, offsets)[2:]


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of five words, in order, and how many each text has).

    A text of one to four words has one shingle, of all its words; one without
    words has none.
    """
    last = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(last - counts, counts)
    left = np.repeat(counts, counts) - place  # words from here on
    keep = (left >= SHINGLE) | (place == 0)
    at = np.flatnonzero(keep)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            there = left[at] > k
            h += np.where(there, words[np.minimum(at + k, len(words) - 1)] * _PLACES[k], np.uint64(k + 1))
    return mix(h), np.bincount(text[at], minlength=len(counts))
