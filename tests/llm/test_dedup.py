"""Exact dedup, n-gram Jaccard join and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudscope.llm import common
from fraudscope.llm import exact_dedup as ed
from fraudscope.llm import jaccard_join as jj
from fraudscope.llm import suffix_dedup as sd
from fraudscope.llm import suffixes
from fraudscope.llm.common import one_of_repeats
from fraudscope.llm.components import components

LAST = float("inf")


def _order(i):
    return LAST if i is None else i


def _normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_duplicates(edge_docs, edge_rows):
    groups = defaultdict(list)
    for r in edge_rows:
        groups[_normal(r[1])].append(r[0])
    want = Counter()
    for r in edge_rows:
        ids = groups[_normal(r[1])]
        want[r[0], min(ids, key=_order), len(ids), hashlib.sha256(_normal(r[1]).encode()).hexdigest()] += 1
    got = ed.exact_duplicates(edge_docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len(groups)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_drop_exact_duplicates_keeps_rows(edge_docs, edge_rows):
    got = ed.drop_exact_duplicates(edge_docs)
    assert got.columns == edge_docs.columns
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len({_normal(r[1]) for r in edge_rows})
    assert set(rows) <= set(edge_rows)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_perfect_hash(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    seeds, slots = ed.perfect_hash(digests)
    assert sorted(slots) == list(range(n))
    table = digests[np.argsort(slots)]
    assert (ed.lookup(seeds, table, digests) == slots).all()
    others = np.frombuffer(b"".join(hashlib.sha256(f"x{i}".encode()).digest() for i in range(50)), np.uint8).reshape(-1, 32)
    assert (ed.lookup(seeds, table, others) == -1).all()


def _shingles(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def _join(rows):
    """{(doc_id, shingle set): (class_id, copy_id, n_copies, n_links)} by comparing all sets."""
    copies = defaultdict(list)
    for r in rows:
        copies[_shingles(r[1])].append(r[0])
    sets = list(copies)
    links = {s: [t for t in sets if t != s and s and t and 5 * len(s & t) >= 4 * len(s | t)] for s in sets}
    out = {}
    for s in sets:
        seen, todo = {s}, [s]
        while todo:
            for t in links[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        first = min((i for t in seen for i in copies[t]), key=_order)
        out[s] = (first, min(copies[s], key=_order), len(copies[s]), len(links[s]))
    return out


def test_jaccard_join(edge_docs, edge_rows):
    found = _join(edge_rows)
    want = Counter((r[0], *found[_shingles(r[1])]) for r in edge_rows)
    got = jj.jaccard_join(edge_docs)
    assert got.columns == ["doc_id", "class_id", "copy_id", "n_copies", "n_links"]
    assert Counter(map(tuple, got.collect())) == want
    assert max(k[4] for k in want) >= 15  # the near copies are linked with each other


def test_jaccard_join_splits_large_groups(edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(jj, "NODE_BLOCK", 4)
    monkeypatch.setattr(jj, "VERIFY_BLOCK", 3)
    found = _join(edge_rows)
    assert Counter(map(tuple, jj.jaccard_join(edge_docs).collect())) == Counter((r[0], *found[_shingles(r[1])]) for r in edge_rows)


def test_drop_near_duplicates(edge_docs, edge_rows):
    got = jj.drop_near_duplicates(edge_docs)
    assert got.columns == edge_docs.columns
    rows = [tuple(r) for r in got.collect()]
    found = _join(edge_rows)
    assert sorted(_order(r[0]) for r in rows) == sorted(_order(c) for c in [v[0] for v in _one_each(found)])
    assert set(rows) <= set(edge_rows)


def _one_each(found):
    """One entry for each near-duplicate class (sets of a class share class id and are linked)."""
    seen, out = set(), []
    for s, v in found.items():
        if s in seen:
            continue
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [t for t in found if t not in seen and x and t and 5 * len(x & t) >= 4 * len(x | t)]
        out.append(v)
    return out


def test_forest_depth_meets_recall():
    depth = jj.prefix_length(0.9999)
    assert 1 - (1 - 0.8**depth) ** jj.TREES >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** jj.TREES
    assert jj.prefix_length(0.5) > depth


def test_forest_shortens_node_by_node():
    rng = np.random.default_rng(3)

    def row(like=None, share=0.0, head=0):
        """A signature that has ``share`` of another's values, and of the first tree's path exactly the first ``head``."""
        sig = rng.integers(1, 1 << 32, jj.TREES * jj.DEPTH, np.uint64).astype(np.uint32)
        if like is not None:
            same = rng.permutation(np.arange(jj.DEPTH, len(sig)))[: round(share * len(sig))]
            sig[same] = like[same]
            sig[:head] = like[:head]
        return sig

    a, b, c, d = row(), row(), row(), row()
    copies = [a, row(a, 0.9, 6), row(a, 0.9, 6)]
    near, chance = [b, row(b, 0.8, 4)], [c, row(c, 0.1, 4)]
    mixed = [d, row(d, 0.8, 5), row(d, 0.8, 6), row(d, 0.2, 6)]
    sig = np.array([*copies, *near, *chance, *mixed])
    group = np.repeat([0, 1, 2, 3], [3, 2, 2, 4])
    none = np.zeros(len(sig), np.int64)
    label, reached = jj.descend(sig, none, group, np.arange(len(sig)), none, none.astype(bool))
    assert label.tolist() == [0, 0, 0, 3, 3, 5, 6, 7, 7, 7, 10]
    # copies end at full depth; near texts and chance meetings are followed to the shortest prefix
    assert reached.tolist() == [6, 4, 4, 4]
    # across blocks: pairs inside one block are another task's
    block = np.array([0, 0, 0, 1, 1, 0, 1, 0, 0, 1, 1])
    label, _ = jj.descend(sig, none, group, np.arange(len(sig)), block, np.ones(len(sig), bool))
    assert set(np.flatnonzero(label != np.arange(len(sig)))) <= {1, 2, 4, 8, 9}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_one_of_repeats_is_the_least(spark, parts):
    rows = [(i % 5, None if i % 7 == 0 else i * 37 % 11, {"k": i}, [i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, value long, marks map<string,long>, list array<long>").repartition(parts)
    got = {r.id: (r.value, r.list, r.marks) for r in one_of_repeats(df, ["id"]).collect()}
    order = {k: min(((v is not None, v or 0), x, json.dumps(m)) for i, v, m, x in rows if i == k) for k in range(5)}
    assert {k: ((v[0] is not None, v[0] or 0), v[1], json.dumps(v[2])) for k, v in got.items()} == order


@pytest.mark.parametrize("share", [0, 8, 4096])  # no node is a hub, some are, all are
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    hubs = [(200, 201 + i) for i in range(60)] + [(500, 300 + i) for i in range(60)]  # the smallest and the largest node
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + hubs, "a long, b long")).collect()}
    want = {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}
    assert got == {**want, **dict.fromkeys(range(200, 261), 200), **dict.fromkeys([*range(300, 360), 500], 300)}


@pytest.mark.parametrize("share", [0, 8, 4096])
def test_join_of_hot_keys(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(k, k) for k in range(2, 30)] + [(None, 5)], "k long, x long")
    keyed = rows.filter("k < 20").groupBy("k").count().withColumnRenamed("count", "n").withColumn("y", F.col("k") * 2)
    got = common.join_hot(rows, keyed, "k", 79)
    assert got.columns == ["k", "x", "y"]
    assert sorted(map(tuple, got.collect())) == sorted([(1, i, 2) for i in range(50)] + [(k, k, 2 * k) for k in range(2, 20)])


def _remove(rows):
    count = Counter()
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in texts:
        count.update(b[k : k + 400] for k in range(len(b) - 399))
    out = []
    for i, b in texts:
        spans = []
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + 400
                else:
                    spans.append([k, k + 400])
        kept, at = b"", 0
        for s, e in spans:
            kept, at = kept + b[at:s], e
        out.append((i, len(b), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept + b[at:]).hexdigest()))
    return out


@pytest.fixture(scope="module")
def passages(edge_rows):
    import random

    rng = random.Random(1)
    parts = ["".join(rng.choice("abc ") for _ in range(k)) for k in (150, 390, 399, 400, 401, 450, 700, 1300)] + ["a" * 900, "ab" * 450, "é" * 300]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", "x", "é"]) for _ in range(rng.randint(0, 6))) for _ in range(80)]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, None), (6, ""), (7, parts[7]), (7, parts[7])] + [r[:2] for r in edge_rows]


@pytest.mark.parametrize("local", [1024, 2])
def test_suffix_dedup(spark, passages, monkeypatch, local):
    monkeypatch.setattr(sd, "LOCAL_RECORDS", local)  # 2: most passages' edges go the way of very common ones
    docs = spark.createDataFrame(passages, "doc_id long, text string").repartition(5)
    got = sd.remove_repeats(docs).drop("spans").collect()
    assert Counter(map(tuple, got)) == Counter(_remove(passages))


def _thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("local", [1024, 2])
def test_texts_made_to_collide_stay(spark, monkeypatch, local):
    """Texts around a common middle whose windows have equal polynomial hashes and no equal bytes of 400."""
    import random

    monkeypatch.setattr(sd, "LOCAL_RECORDS", local)
    rng, rows = random.Random(8), []
    for n in (256, 1024, 2048):
        middle = "".join(rng.choice("cdefgh ") for _ in range(160))
        for letters in ("ab", "ba"):
            rows.append((len(rows), _thue_morse(n, letters) + middle + _thue_morse(n, letters)))
    rows += [(90, rows[0][1][100:520]), (91, None)]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans").collect()
    assert Counter(map(tuple, got)) == Counter(_remove(rows))


def test_windows_of_one_hash_are_compared_by_bytes(monkeypatch):
    buf = np.frombuffer(b"x" * 400 + b"y" * 400 + b"x" * 400 + b"z" * 400, np.uint8)
    monkeypatch.setattr(sd, "byte_hashes", lambda b, s, e, p: np.zeros(len(s), np.uint64))
    assert sd.repeated_windows(buf, np.array([0, 400, 800, 1200])).tolist() == [True, False, True, False]


def test_rows_without_an_equal_neighbour_are_not_written(spark):
    rows = [(i, i, 0, 1, 0, i // 2 if i < 20 else i, i // 2 if i < 10 else i, 0) for i in range(2000)]  # pairs of bodies, pairs of suffixes, others
    marked = sd.mark_repeats(spark.createDataFrame(rows, sd._RECORD).repartition(3), sd._RECORD, "marked").collect()
    assert sorted(r.doc_id for r in marked if r.prev_gram or r.next_gram) == list(range(20))
    assert sorted(r.doc_id for r in marked if r.prev_body or r.next_body) == list(range(10))
    assert len(marked) <= 20 + 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _peak_mb(run):
    import tracemalloc

    run()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_workers_hold_little_at_a_time():
    import pyarrow as pa

    raw = np.random.default_rng(3).integers(97, 101, 4_000_000).astype(np.uint8)
    texts = [raw[i : i + 4000].tobytes().decode() for i in range(0, len(raw), 4000)]
    records = [[{"a": 100 * k, "n": 100, "gram": k, "single": True} for k in range(30)]] * len(texts)
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "th": range(len(texts)), "text": texts, "records": records})
    assert _peak_mb(lambda: [None for _ in sd._records([batch])]) < 30
    assert _peak_mb(lambda: [None for _ in sd._contexts([batch])]) < 5
    twice = np.tile(raw[:60_000], 2)
    assert _peak_mb(lambda: sd.repeated_windows(twice, np.arange(len(twice) - 400))) < 40


def test_suffix_records_cover_all_windows():
    buf = np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 399, 799, 5000])
    r = suffixes.suffix_records(buf, offsets)
    seen = Counter((t, a + k) for t, a, n in zip(r["text"], r["a"], r["n"]) for k in range(n))
    assert set(seen.values()) == {1} and set(seen) == {(2, 0)} | {(3, k) for k in range(4201 - 399)}


def test_empty_tables(no_docs):
    assert ed.exact_duplicates(no_docs).count() == 0
    assert jj.jaccard_join(no_docs).count() == 0
    assert sd.remove_repeats(no_docs).count() == 0
    assert ed.drop_exact_duplicates(no_docs).columns == no_docs.columns
    assert jj.drop_near_duplicates(no_docs).count() == 0
