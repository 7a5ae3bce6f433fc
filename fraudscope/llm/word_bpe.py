"""Ids of many texts by a word-level BPE tokenizer file, with a cache of chunks between white space.

The tokenizer drops white space and never lets a token or a contraction cross
it, and its normaliser treats each character by itself (NFC does not compose
across a space). So a text's ids are those of its chunks between ASCII white
space, in order, and a chunk seen before need not be encoded again. Arrow splits
the texts and finds the chunks that are new; only these pass through Python.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept by a worker, and ids of theirs: the cache starts anew beyond either (about 30 bytes a chunk).
CACHE_CHUNKS, CACHE_IDS = 600_000, 6_000_000
#: Bytes encoded together: bounds the arrays of a slice of documents (a longer text is a slice of its own).
SLICE_BYTES = 2_000_000
#: Found in chunks that the tokenizer encodes itself: characters that may be white space, have
#: compositions or do not lower case one by one, and the start of a special token.
_ODD = r"[^!-~\x{a1}-\x{12f}\x{131}-\x{17f}]|<\|"
#: Fixed value: the tokenizer file's pattern of pre-tokens.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: 256 + k for k, b in enumerate(others)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _IdLists:
    """Lists of ids by the string they belong to; strings are numbered as they come."""

    def __init__(self):
        self.strings = pa.array([], pa.large_string())
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def numbers(self, strings: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(number of each string, the new ones among them by number); the ids of the new ones are to be added."""
        known = len(self.strings)
        coded = pa.concat_arrays([self.strings, strings]).dictionary_encode()
        self.strings = coded.dictionary
        return coded.indices.slice(known), self.strings.slice(known)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the new strings, which lie in a row."""
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def take(self, numbers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the strings of these numbers in a row, where each string's begin, and the end)."""
        return _take(self.ids, self.ends, numbers)


class WordBpe:
    def __init__(self, path: str):
        # threads of its own would outnumber the task's core, and can hang in a forked worker
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        import regex

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        # a line break ends a chunk: no pre-token holds one
        self.pre_tokens = regex.compile(f"{_PRE_TOKENS}|\n").findall
        self.letters = _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.by_pre_token, self.by_chunk = _IdLists(), _IdLists()
        self.by_pre_token.numbers(pa.array(["\n"], pa.large_string()))
        self.by_pre_token.add(np.empty(0, np.uint32), np.zeros(1, np.int64))

    def _pre_token_ids(self, token: str) -> list[int]:
        letters = token if token.isascii() else token.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenize(letters)]

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, ids of each)."""
        odd = pc.match_substring_regex(chunks, _ODD)
        plain_ids, plain_sizes = self._encode_plain(_strings(chunks.filter(pc.invert(odd))))
        odd_ids, odd_sizes = _in_a_row([self.tokenizer.encode(c, add_special_tokens=False).ids for c in _strings(chunks.filter(odd))])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([plain_sizes, odd_sizes]))])
        # the plain ones lie before the odd ones
        place = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"))
        ids, starts = _take(np.concatenate([plain_ids, odd_ids]), ends, pa.array(place))
        return ids, np.diff(starts)

    def _encode_plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the pre-tokens of chunks that are not odd."""
        tokens = self.pre_tokens("\n".join([*chunks, ""]).lower())
        number, new = self.by_pre_token.numbers(pa.array(tokens, pa.large_string()))
        self.by_pre_token.add(*_in_a_row([self._pre_token_ids(t) for t in _strings(new)]))
        ids, starts = self.by_pre_token.take(number)
        ends = starts[np.flatnonzero(number.to_numpy() == 0)]
        return ids, np.diff(ends, prepend=0)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids of each text)."""
        if len(self.by_chunk.strings) > CACHE_CHUNKS or len(self.by_chunk.ids) > CACHE_IDS:
            self._clear()
        split = pc.ascii_split_whitespace(texts)
        number, new = self.by_chunk.numbers(split.flatten())
        if len(new):
            self.by_chunk.add(*self._learn(new))
        ids, starts = self.by_chunk.take(number)
        return ids, np.diff(starts[split.offsets.to_numpy()])

    def slices(self, texts: pa.Array | list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids in a row, ids of each text) of slices of ``texts`` (none missing) of bounded size."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        first, before = 0, 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield (first, *self._encode(texts.slice(first, last - first)))
            # Arrow's pool keeps what the slice has freed, in every worker
            pa.default_memory_pool().release_unused()
            first, before = last, ends[last - 1]


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _take(ids: np.ndarray, ends: np.ndarray, numbers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lists of these numbers in a row, where each begins, and the end), of lists that lie in a row."""
    taken = pa.LargeListArray.from_arrays(ends, ids).take(numbers)
    return taken.values.to_numpy(), taken.offsets.to_numpy()


def _in_a_row(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all values in a row, length of each list)."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes
