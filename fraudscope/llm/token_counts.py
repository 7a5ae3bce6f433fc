"""Token counts under a unigram model, by dynamic programming on a trie of pre-tokens.

A text's pre-tokens are its words, each after the mark U+2581. The distinct
pre-tokens of a slice of documents are put in a trie, level by level; the best
score of a segmentation of each prefix is worked out once for all words that
share it, from the scores of its ancestors. The terminal nodes hold the counts,
which the documents add up. Nothing is shuffled: a task's memory is that of a
slice, and a lost task is simply run again.

The unigram model is the public vocabulary's pieces in its order, with the
probabilities of Zipf's law: nothing is trained. A byte that no piece covers is
a token of its own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudscope.llm.common import table
from fraudscope.llm.hashing import BYTES, mix, powers, text_slices, word_bounds

MARK = "▁".encode()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def unigram_scores(path: str) -> dict[bytes, float]:
    """Log probability of each piece, in the file's order; every byte has one, less likely than any piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i).encode() for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    whole = np.log(np.sum(1.0 / np.arange(1, len(pieces) + 1)))
    last = -np.log(256.0 * len(pieces)) - whole
    scores = {bytes([b]): float(last) for b in range(256)}
    scores.update((p, float(-np.log(r) - whole)) for r, p in enumerate(pieces, 1))
    return scores


@lru_cache(maxsize=2)
def _piece_table(path: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(sorted hashes, their scores, lengths that pieces have)."""
    scores = unigram_scores(path)
    hashes = np.empty(len(scores), np.uint64)
    with np.errstate(over="ignore"):
        for i, p in enumerate(scores):
            b = np.frombuffer(p, np.uint8)
            hashes[i] = np.sum(BYTES[b] * powers(len(b))[0], dtype=np.uint64)
    hashes = mix(hashes)
    order = np.argsort(hashes)
    if (np.diff(hashes[order]) == 0).any():
        raise ValueError("two pieces of the vocabulary share a hash")
    return hashes[order], np.array(list(scores.values()))[order], sorted({len(p) for p in scores})


def trie_counts(words: tuple[np.ndarray, np.ndarray, np.ndarray], path: str) -> np.ndarray:
    """Tokens of each word, given as (bytes, starts, ends); of equal scores the one with fewer tokens."""
    buf, starts, ends = words
    hashes, scores, lengths = _piece_table(path)
    n, mark = len(starts), np.frombuffer(MARK, np.uint8)
    size = ends - starts + len(mark)
    out = np.zeros(n, np.int64)
    alive = np.arange(n)  # the words that reach this level
    node = np.zeros(n, np.int64)  # of each of them, at the last level
    back = lengths[-1]
    # of the last levels, the newest first: best score, its tokens, path hash; and where each node's ancestors are
    best, count, paths = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)]
    ancestors = [np.zeros(1, np.int64)]
    level = 0
    while len(alive):
        byte = mark[level] if level < len(mark) else buf[starts[alive] + level - len(mark)]
        key, node = np.unique(node * 256 + byte, return_inverse=True)
        parent, letter = key // 256, (key % 256).astype(np.uint8)
        power, inverse = powers(level + 1)
        with np.errstate(over="ignore"):
            path_hash = paths[0][parent] + BYTES[letter] * power[level]
        ancestors = [a[parent] for a in ancestors]
        level += 1
        top, tokens = np.full(len(key), -np.inf), np.zeros(len(key), np.int64)
        for k in lengths:
            if k > level:
                break
            at = ancestors[k - 1]
            with np.errstate(over="ignore"):
                h = mix((path_hash - paths[k - 1][at]) * inverse[level - k])
            found = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            score = np.where(hashes[found] == h, best[k - 1][at] + scores[found], -np.inf)
            own = count[k - 1][at] + 1
            better = (score > top) | ((score == top) & (own < tokens))
            top, tokens = np.where(better, score, top), np.where(better, own, tokens)
        best, count, paths = [top, *best[: back - 1]], [tokens, *count[: back - 1]], [path_hash, *paths[: back - 1]]
        ancestors = [np.arange(len(key)), *ancestors[: back - 1]]
        done = size[alive] == level
        out[alive[done]] = tokens[node[done]]
        alive, node = alive[~done], node[~done]
    return out


def token_counts(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pretokens, n_tokens.

    NULL and empty texts have neither; repeated rows each get their row.
    """
    path = model or default_path()

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for first, buf, offsets in text_slices(batch.column("text")):
                starts, ends, hashes, per_text = word_bounds(buf, offsets)
                _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
                tokens = trie_counts((buf, starts[sample], ends[sample]), path)[which]
                total = np.concatenate([[0], np.cumsum(tokens)])
                last = np.cumsum(per_text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(per_text)), pa.array(per_text), pa.array(total[last] - total[last - per_text])],
                    names=["doc_id", "n_pretokens", "n_tokens"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
