"""Suffixes at content-defined places of texts, and hashes of their windows."""

from __future__ import annotations

import hashlib

import numpy as np

from fraudscope.llm.hashing import mix, powers, prefix_hash

#: Bytes of a string that counts as a repeat.
WINDOW = 400
#: Leading bytes that choose and identify a suffix; every window holds WINDOW - GRAM + 1 such strings.
GRAM = 128
#: The low bits hold the place, so that of equal hashes the first in the text is the least.
_PLACE_BITS = np.uint64(36)


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Hash of each byte string buf[start:end]; ``p`` is the buffer's prefix hash."""
    with np.errstate(over="ignore"):
        return mix((p[ends] - p[starts]) * powers(len(buf) + 1)[1][starts])


def strong_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit BLAKE2 digest of each byte string buf[start:end], as two longs: equal only for equal strings."""
    view = memoryview(np.ascontiguousarray(buf))
    digests = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist()))
    both = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row: prefix minima and suffix minima of blocks meet."""
    n = len(v) - width + 1
    pad = -len(v) % width
    blocks = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def suffix_records(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """One record for each chosen suffix of the texts in ``buf``.

    Every window of WINDOW bytes chooses the GRAM bytes in it with the least
    hash (the first of equals); equal windows choose the same bytes at the same
    place. A record stands for the neighbouring windows that choose one suffix:
    text, first window ``a`` (bytes from the text's start), number of windows
    ``n``, ``gram`` (hash of the chosen bytes), ``lead`` (its first eight
    bytes, as a number in byte order) and ``body`` and ``tail`` (128-bit digest of all
    bytes that its windows cover). The gram's hash only brings suffixes together; what
    counts as equal rests on the digest.
    """
    width = WINDOW - GRAM + 1
    lengths = np.diff(offsets)
    if len(buf) < WINDOW or lengths.max(initial=0) < WINDOW:
        none = np.empty(0, np.int64)
        return {"text": none, "a": none, "n": none, "gram": none, "lead": none, "body": none, "tail": none}
    p = prefix_hash(buf)
    grams = len(buf) - GRAM + 1
    at = np.arange(grams)
    h = byte_hashes(buf, at, at + GRAM, p)
    order = ((h >> _PLACE_BITS) << _PLACE_BITS) | at.astype(np.uint64)
    chosen = (_sliding_min(order, width) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    # windows that lie in one text
    sizes = np.maximum(lengths - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(lengths)), sizes)
    window = np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(text))
    pick = chosen[window]
    new = np.concatenate([[True], (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    start, suffix, text = window[first], pick[first], text[first]
    lead = np.zeros(len(first), np.uint64)
    for k in range(8):
        lead = (lead << np.uint64(8)) | buf[suffix + k]
    body, tail = strong_hashes(buf, start, start + count - 1 + WINDOW)
    return {
        "text": text,
        "a": start - offsets[text],
        "n": count,
        "gram": h[suffix].view(np.int64),
        "lead": (lead ^ np.uint64(1 << 63)).view(np.int64),  # signed order is byte order
        "body": body,
        "tail": tail,
    }
