"""Raking, site posteriors and the whole pipeline against plain Python."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fraudscope.llm import mixing, quality_classifier
from fraudscope.llm.common import materialise
from fraudscope.llm.word_bpe import default_path
from fraudscope.session import scratch_path
from tests.llm.conftest import SCHEMA
from tests.llm.test_dedup import _join, _normal, _one_each, _order, _shingles
from tests.llm.test_operators import _figures

MARGINS = ("source", "lang", "topic")


def _rake(cells, targets, cycles=3000):
    """{cell: weight} by plain proportional fitting of {cell: tokens}."""
    w = {c: float(t) for c, t in cells.items() if t}
    for _ in range(cycles):
        for at, target in enumerate(targets):
            sums = defaultdict(float)
            for c, x in w.items():
                sums[c[at]] += x
            w = {c: x * target[c[at]] / sums[c[at]] for c, x in w.items()}
    whole = sum(w.values())
    return {c: x / whole for c, x in w.items()}


def _tempered(cells, at, power):
    sums = defaultdict(float)
    for c, t in cells.items():
        sums[c[at]] += t
    p = {v: t**power for v, t in sums.items() if t}
    return {v: x / sum(p.values()) for v, x in p.items()}


def test_cell_weights_equal_a_plain_rake(spark):
    rng = np.random.default_rng(8)
    cells = {(s, l, t): int(rng.integers(1, 5000)) for s in "abc" for l in ("en", "fr") for t in "xyz" if rng.random() < 0.8}
    powers = (0.5, 0.2, 0.8)
    targets = [_tempered(cells, at, p) for at, p in enumerate(powers)]
    df = spark.createDataFrame([(*c, t) for c, t in cells.items()], "source string, lang string, topic string, tokens long")
    raked = mixing.rake(df, {m: mixing.tempered_targets(df, m, p) for m, p in zip(MARGINS, powers)})
    want = _rake(cells, targets, 300)
    got = {(r.source, r.lang, r.topic): r.weight for r in raked.collect()}
    assert got.keys() == want.keys() and np.allclose([got[c] for c in want], list(want.values()), rtol=1e-4)
    factor = {c: want[c] / cells[c] for c in want}
    for r in mixing.cell_probabilities(raked).collect():
        assert np.isclose(r.probability, factor[r.source, r.lang, r.topic] / max(factor.values()), rtol=1e-4)


def _weight(sites):
    """Prior weight by moments from (n, s, prior mean) of sites."""
    n = sum(k for k, _, _ in sites)
    own = (sum(k * (s / k - m) ** 2 for k, s, m in sites) - sum(m * (1 - m) for *_, m in sites)) / n
    spread = sum(k * m * (1 - m) for k, _, m in sites) / n
    low, high = quality_classifier.LEAST_WEIGHT, quality_classifier.MOST_WEIGHT
    return high if own <= 0 else min(high, max(low, spread / own - 1))


def test_site_posteriors_by_hand(spark):
    planted = {("good", "p"): (200, 190), ("good", "q"): (40, 10), ("bad", "p"): (100, 12), ("bad", "q"): (3, 3), ("tiny", "p"): (1, 0)}
    rows = [(h, p, float(i < s)) for (h, p), (n, s) in planted.items() for i in range(n)]
    sites, corpus, weight = quality_classifier.site_posteriors(spark.createDataFrame(rows, "host string, path string, value double").repartition(5))
    hosts = defaultdict(lambda: [0, 0])
    for (h, _), (n, s) in planted.items():
        hosts[h][0] += n
        hosts[h][1] += s
    mean = sum(s for _, s in hosts.values()) / sum(n for n, _ in hosts.values())
    a = _weight([(n, s, mean) for n, s in hosts.values()])
    rate = {h: (s + a * mean) / (n + a) for h, (n, s) in hosts.items()}
    assert np.isclose(corpus, mean)
    assert np.isclose(weight, _weight([(n, s, rate[h]) for (h, _), (n, s) in planted.items()]))
    got = {(r.host, r.path): (r.n, r.s, r.host_rate) for r in sites.collect()}
    assert got.keys() == planted.keys()
    for k, (n, s) in planted.items():
        assert got[k][:2] == (n, s) and np.isclose(got[k][2], rate[k[0]])
    assert abs(rate["tiny"] - mean) < abs(rate["bad"] - mean)  # the sparse host is shrunk most


def test_sites_decide_between_equal_texts(spark):
    text = " ".join(f"word{i % 40}" for i in range(60))
    rows = [(i, text, "en", "good" if i < 100 else "bad") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 95 or i == 150)) for i in range(200) if i % 10], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len({round(r.own_score, 9) for r in got.values()}) == 1  # by its own text no document differs from another
    value = {i: (float(i < 95 or i == 150) if i % 10 else got[i].own_score) for i in range(200)}
    corpus = sum(value.values()) / 200
    sums = {"good": sum(value[i] for i in range(100)), "bad": sum(value[i] for i in range(100, 200))}
    a = _weight([(100, s, corpus) for s in sums.values()])
    rate = {h: (s + a * corpus) / (100 + a) for h, s in sums.items()}
    b = _weight([(100, s, rate[h]) for h, s in sums.items()])

    def odds(p):
        p = min(max(p, quality_classifier.MARGIN), 1 - quality_classifier.MARGIN)
        return np.log(p / (1 - p))

    for i, r in got.items():
        h = "good" if i < 100 else "bad"
        path = (sums[h] - value[i] + b * rate[h]) / (99 + b)
        score = 1 / (1 + np.exp(-(odds(r.own_score) + odds(path) - odds(corpus))))
        assert np.isclose(r.host_score, rate[h]) and np.isclose(r.path_score, path) and np.isclose(r.score, score)
        assert r.kept == (i < 100)


def _documents(spark, df):
    folder = scratch_path(spark, "test-documents")
    df.write.parquet(f"{folder}/documents.parquet")
    return folder


def _quality(rows):
    """Rows that pass the base rules and those in force on their host."""
    fails = []
    for r in rows:
        n, chars, symbols, dup, repeat = _figures(r[1])[:5]
        soft = [100 * symbols > 10 * chars, 100 * repeat > 30 * n, 100 * dup > 10 * n, 100 * chars > 1200 * n]
        fails.append((n < 50 or 100 * repeat > 50 * n, [any(soft), *soft]))
    hosts = defaultdict(list)
    for r, (_, k) in zip(rows, fails):
        hosts[r[3] or ""].append(k)
    docs, means, rates = len(rows), [], []
    for i in range(5):
        m = sum(k[i] for _, k in fails) / docs
        v = (sum(len(h) * (sum(k[i] for k in h) / len(h) - m) ** 2 for h in hosts.values()) - len(hosts) * m * (1 - m)) / docs
        a = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
        means.append(m)
        rates.append({name: (sum(k[i] for k in h) + m * a) / (len(h) + a) for name, h in hosts.items()})
    out = []
    for r, (base, k) in zip(rows, fails):
        host = r[3] or ""
        hit = k[0] and rates[0][host] >= 0.5
        for i in range(1, 5):
            x, m = rates[i][host], means[i]
            hit = hit or (k[i] and x * (1 - m) >= 0.5 * m * (1 - x))
        if not base and not hit:
            out.append(r)
    return out


def _topic(text):
    text = text or ""

    def share(chars):
        return 100 * sum(c in chars for c in text)

    n = len(text)
    return "markup" if share("#*$%&|<>{}=") > 3 * n else "numbers" if share("0123456789") > 5 * n else "lists" if share("\n") > 3 * n else "prose"


def _mixed(spark, rows):
    """Rows that plain raking samples, with Spark's hash for the draws."""
    cell = {r: (r[3] or "", r[2] or "", _topic(r[1])) for r in rows}
    cells = defaultdict(int)
    for r in rows:
        cells[cell[r]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    targets = [_tempered(cells, at, p) for at, p in enumerate((0.7, 0.9, 1.0))]
    weights = _rake(cells, targets)
    top = max(w / cells[c] for c, w in weights.items())
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    drawn = {(r.doc_id, r.text): r.d for r in spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", draw.alias("d")).collect()}
    return [r for r in rows if drawn[r[0], r[1]] < weights.get(cell[r], 0.0) / cells[cell[r]] / top]


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_pipeline_stage_by_stage(spark, edge_docs, edge_rows):
    folder = _documents(spark, edge_docs)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), edge_rows
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = after[name] = materialise(stage(spark, docs, folder), f"test-{name}")
        if name != "packing":
            assert docs.columns == edge_docs.columns
        if name == "quality_rules":
            kept = _quality(kept)
        elif name == "exact_dedup":
            first = {}
            for r in kept:  # the smallest id, then the least row
                best = first.setdefault(_normal(r[1]), r)
                if (_order(r[0]), repr(r)) < (_order(best[0]), repr(best)):
                    first[_normal(r[1])] = r
            kept = list(first.values())
        elif name == "near_dedup":
            found = _join(kept)
            firsts = {c for c, *_ in _one_each(found)}
            kept = [r for r in kept if r[0] in firsts and found[_shingles(r[1])][0] == r[0] == found[_shingles(r[1])][1]]
        elif name == "mixing":
            kept = _mixed(spark, kept)
        if name != "packing":
            assert _sorted(docs.collect()) == _sorted(kept), name
            assert kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert after["quality_rules"].count() > after["exact_dedup"].count() > after["near_dedup"].count() > after["mixing"].count()

    tokenizer = Tokenizer.from_file(default_path())
    pieces, sizes = [], []
    for r in kept:
        n = len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1
        for k, start in enumerate(range(0, n, 2048)):
            sizes.append(min(2048, n - start))
            pieces.append((r[0], k, start, sizes[-1]))
    packed = docs.collect()
    assert _sorted((r.doc_id, r.piece, r.start, r.length) for r in packed) == _sorted(pieces)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    whole = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert _sorted(whole.select(*key).collect()) == _sorted(docs.select(*key).collect())
    assert -(-sum(sizes) // 2048) <= len(bins) <= -(-sum(sizes) // 2048) + 1


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_an_empty_table(spark, no_docs, stage):
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, no_docs, "")
    assert out.count() == 0
    assert name == "packing" or out.columns == no_docs.columns
