"""Words, pieces and n-gram keys of texts, vectorised over Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from fraudscope.llm.hashing import mix, text_slices

#: Bytes of text taken apart at a time (a longer text alone): bounds a task's arrays.
PHRASE_SLICE = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# 0: part of a word; 1: between words; 2: between pieces
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a slice of texts: numbered by spelling, with their piece and language."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, langs: np.ndarray, seeds: np.ndarray):
        """``langs``: number of each text's language; ``seeds``: a 64-bit value for each language."""
        import pyarrow as pa

        kind, breaks = _KIND[buf], np.zeros(len(buf) + 1, np.int64)
        np.cumsum(kind == 2, out=breaks[1:])
        inside = kind == 0
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])[: len(buf)]) if len(buf) else np.zeros(0, np.int64)
        ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if len(buf) else starts
        text = np.searchsorted(offsets, starts, "right") - 1
        self.piece = breaks[starts] + text  # neighbours of one piece agree; others differ
        self.lang = langs[text]
        letters = _LOWER[buf[inside]]
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        spelled = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters.tobytes())])
        coded = spelled.dictionary_encode()
        self.spelling = coded.dictionary
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        own = (xxhash.xxh3_64_intdigest(w) for w in self.spelling.to_pylist())
        self._own, self._seed = np.fromiter(own, np.uint64, len(self.spelling)), seeds

    def __len__(self) -> int:
        return len(self.word)

    def keys(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(m, places where a run of m words of one piece starts, their 64-bit keys), for m from 1."""
        n = len(self)
        at = np.arange(n)
        with np.errstate(over="ignore"):
            own = mix(self._own[self.word] + self._seed[self.lang]) if n else np.zeros(0, np.uint64)
            key = own
            for m in range(1, longest + 1):
                yield m, at, mix(key + np.uint64(m) * _STEP)
                last = at + m
                ok = last < n
                ok[ok] = self.piece[last[ok]] == self.piece[at[ok]]
                at = at[ok]
                key = mix(key[ok] * _STEP + own[at + m])


def slices(texts, langs) -> Iterator[tuple[Words, list[str]]]:
    """``Words`` of slices of the texts, from Arrow columns without NULLs, and the languages' names."""
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    seeds = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=11) for x in names], np.uint64)
    for first, buf, offsets in text_slices(texts, PHRASE_SLICE):
        yield Words(buf, offsets, numbers[first : first + len(offsets) - 1], seeds), names
