"""Phrase collocations, the Merkle manifest and exact search against brute force on edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fraudscope.llm import merkle, phrases, vector_search
from fraudscope.llm.phrase_words import slices

# ---------------------------------------------------------------- phrases


def _counted(rows, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    return f, n


def _collocations(f, n, least):
    frequent = {k: a for k, a in f.items() if a >= least}
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        inside = any(
            g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in frequent.items()
        )
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)
    return out


def _phrase_rows():
    rng = random.Random(3)
    vocabulary = ["the", "of", "Ünder", "x-1", "New", "york", "new", "É", "the of", "a"]
    rows = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))), rng.choice(["en", "fr", None])) for _ in range(150)]
    rows += [("new york city hall, NEW YORK\tcity  hall!the of", "en")] * 12 + [(None, "en"), ("", None), (" ,.!\n", "de"), ("solo", "de"), ("ab" * 9000, "en")]
    return rows + [("long " * 20_000 + "way home", "es")]


@pytest.mark.parametrize("portion", [1 << 22, 60])
def test_phrases_against_brute_force(spark, monkeypatch, portion):
    monkeypatch.setattr(phrases, "PORTION", portion)
    rows, least = _phrase_rows(), 5
    docs = spark.createDataFrame([(t, x, 1, "p") for t, x in rows], "text string, lang string, n int, phrase string").repartition(5)
    counts = phrases.phrase_counts(docs, "text", "lang", 5, least)
    f, n = _counted(rows, 5)
    got = counts.collect()
    assert {(r.lang, r.phrase): r.n for r in got if r.m} == {(x, " ".join(p)): a for (x, p), a in f.items() if a >= least}
    assert {r.lang: r.n for r in got if not r.m} == {x: c for x, c in n.items() if c}
    want = _collocations(f, n, least)
    scored = phrases.collocations(counts)
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in scored.collect()} == want
    best = phrases.best_by_lang(scored, 3).collect()
    by_lang = defaultdict(list)
    for (x, p), v in want.items():
        by_lang[x].append((-v[4], -v[0], p.encode()))
    assert {(r.lang, r.rank, r.phrase.encode()) for r in best} == {(x, i + 1, p) for x, v in by_lang.items() for i, (_, _, p) in enumerate(sorted(v)[:3])}


def test_phrases_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.best_by_lang(phrases.collocations(phrases.phrase_counts(docs, "text", "lang", 5, 100)), 10).collect() == []


def test_score_is_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", 0, "", 10**15), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)]
    r = phrases.collocations(spark.createDataFrame(rows, "lang string, m int, phrase string, n long")).first()
    assert r.score == 1000 * (big - 1) * 10**15 // (big * (big + 1))


def test_misra_gries_keeps_every_frequent_key():
    rng = np.random.default_rng(5)
    for least in (2, 7, 30):
        keys = np.concatenate([rng.zipf(1.3, 5000) % 3000, np.repeat(7777, least)]).astype(np.uint32)
        rng.shuffle(keys)
        capacity = len(keys) // least + 1
        parts = [phrases.MisraGries(capacity) for _ in range(4)]
        for i, chunk in enumerate(np.array_split(keys, 40)):
            parts[i % 4].merge(*phrases.distinct(chunk))
        whole = phrases.MisraGries(capacity)
        for p in parts:
            whole.merge(p.keys, p.counts, p.error)
        assert whole.error < least and len(whole.keys) <= capacity
        true = Counter(keys.tolist())
        assert {k for k, c in true.items() if c >= least} <= set(whole.at_least(least).tolist())
        assert all(c <= true[k] <= c + whole.error for k, c in zip(whole.keys.tolist(), whole.counts.tolist()))


def test_equal_keys_of_different_runs_are_told_apart():
    import pyarrow as pa

    ((words, _),) = slices(pa.array(["a b a c a b", "a b"]), pa.array(["en", "fr"]))
    at = np.array([0, 2, 4, 6])
    place, n, _ = phrases.exact_groups(words, 2, at, np.zeros(4, np.uint64))
    spelled = {(int(words.lang[p]), *(words.spelling[int(words.word[p + j])].as_py() for j in (0, 1))): int(c) for p, c in zip(place, n)}
    assert spelled == {(0, b"a", b"b"): 2, (0, b"a", b"c"): 1, (1, b"a", b"b"): 1}


# ---------------------------------------------------------------- manifest


def _h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _leaf(*values):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def _up(levels, i, own):
    """(siblings, root that ``own`` leads to)."""
    found = []
    for level in levels[:-1]:
        sibling = level[i ^ 1] if i ^ 1 < len(level) else None
        found += [sibling] if sibling else []
        own = _h(own) if sibling is None else _h(sibling, own) if i % 2 else _h(own, sibling)
        i //= 2
    return found, own


def _manifest(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    by_lang = defaultdict(list)
    for d, text, lang, source, n in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
        leaf = _leaf(d, source, lang, n, text)
        by_lang[lang].append((d is not None, d or 0, leaf, _leaf(d, source, lang, n + 1, text) if hit else leaf, d))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: _tree([r[2] for r in sorted(by_lang[x])]) for x in langs}
    top = _tree([trees[x][-1][0] for x in langs])
    out = Counter()
    for t, x in enumerate(langs):
        for i, (_, _, leaf, changed, d) in enumerate(sorted(by_lang[x])):
            low, subroot = _up(trees[x], i, changed)
            high, folded = _up(top, t, subroot)
            out[d, leaf, trees[x][-1][0], top[-1][0], _h(*low, *high), folded, folded == top[-1][0]] += 1
    return out


def _found(docs):
    from pyspark.sql import functions as F

    leaves = merkle.dataset_leaves(docs)
    found = merkle.manifest(leaves)
    found = found.withColumn("folded", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    p = F.sha2(F.array_join(merkle.proof(F.col("path")), ""), 256).alias("proof")
    rows = found.select("doc_id", "leaf", "subroot", "root", p, "folded", "digest").collect()
    assert all(r.digest == r.leaf for r in rows)  # the descent ends at the leaf asked for
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded, r.folded == r.root) for r in rows)


def test_manifest_against_brute_force(spark, edge_rows):
    rows = [r[:5] for r in edge_rows] + [(1000 + i, f"t{i}", "en", "a", i if i % 3 else None) for i in range(700)]
    rows += [(5000, "copy", "xx", "a", 1)] * 600 + [(6000 + i, "é", "é", None, 2) for i in range(257)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rank string").repartition(7)
    assert _found(docs) == _manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", None, "s", 1)], [(i, "a", None, "s", 1) for i in range(3)], [(1, "a", f"l{i}", "s", 1) for i in range(300)]])
def test_manifest_of_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert _found(docs) == _manifest(rows)


# ---------------------------------------------------------------- search


def _search(rows, k, factor, is_query):
    own = [(i, [math.floor(factor * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (q, u) in enumerate(own):
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(u, v)), i) for b, (i, v) in enumerate(own) if b != a and len(v) == len(u))
            for rank, (s, i) in enumerate(scored[:k]):
                out[q, rank + 1, i, -s] += 1
    return out


@pytest.mark.parametrize("block", [8192, 16])
def test_search_against_brute_force(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    monkeypatch.setattr(vector_search, "BLOCK", block)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 8)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(5)]) for i in range(150)]
    rows += [(200 + i, [0.5, -0.25, 0.0, 1.0, 0.125]) for i in range(60)]  # a group of copies
    rows += [(300, [0.1] * 5)] * 3 + [(300, [0.2] * 5), (301, [float("nan")] * 5), (302, [float("inf")] * 5), (303, None), (304, [None] * 5), (None, [0.1] * 5)]
    rows += [(400, []), (401, []), (500, [2.0, 3.0]), (501, [1.0, 1.0]), (600, [1e5] * 7), (-20, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(6)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = vector_search.exact_top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 6, 64.0)
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == _search(rows, 6, 64.0, lambda i: i % 20 == 0)
    none = vector_search.exact_top_k(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 6, 64.0)
    assert none.collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, x = rng.integers(-70, 70, (9, 12)), rng.integers(-70, 70, (200, 12))
    lo, hi = x - rng.integers(0, 5, x.shape), x + rng.integers(0, 5, x.shape)
    lower, upper = vector_search.bounds(q, lo, hi)
    assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all()
    huge = vector_search.bounds(q * 2**40, lo * 2**20, hi * 2**20)
    assert (huge[1] == upper.astype(object) * 2**60).all()
