"""The other operators: oracles on the given tables, brute force on edge cases."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fraudscope.llm import chat, licenses, mixing, packing, quality_classifier, quality_rules, token_counts, word_bpe
from fraudscope.llm.common import table
from fraudscope.llm.queries import ORACLES, QUERIES
from fraudscope.llm.word_bpe import WordBpe, default_path
from tests.conftest import SF01
from tools.oracle_check import compare


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, duck01, key):
    r = compare(QUERIES[key](spark, SF01), ORACLES[key], duck01)
    assert r.ok, r.message


def _figures(text):
    t = text or ""
    w = [x for x in t.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if x]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
    symbols = sum(c in "#*$%&|<>" for c in t)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_base_figures(edge_docs, edge_rows):
    got = quality_rules.base_figures(edge_docs).collect()
    want = Counter((r[0], *_figures(r[1])) for r in edge_rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_host_verdict_takes_effect(edge_docs, edge_rows):
    rows = quality_rules.quality_verdicts(edge_docs, ["doc_id"]).collect()
    assert len(rows) == len(edge_rows)
    spam = [r for r in rows if r.doc_id is not None and 500 <= r.doc_id < 512]
    assert all(r.host_bad and not r.base_failed and not r.kept for r in spam)
    assert all(r.kept for r in rows if not r.base_failed and not r.soft_failed)  # clean documents stay
    kept = quality_rules.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_host_verdicts_by_hand(spark):
    """Posterior rates of each rule worked out in plain Python; a clean host forgives, the others do not."""
    prose = [f"w{i}" for i in range(80)]
    marked = " ".join(w + "%%#" for w in prose)  # breaks the symbol rule
    rows, made = [], {"clean": (400, 1), "usual": (200, 40), "tiny": (3, 1), "wild": (150, 75), None: (40, 8)}
    for host, (n, bad) in made.items():
        rows += [(len(rows) + i, marked if i < bad else " ".join(prose), host) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total, failed = sum(n for n, _ in made.values()), sum(b for _, b in made.values())
    m = failed / total
    v = (sum(n * (b / n - m) ** 2 for n, b in made.values()) - len(made) * m * (1 - m)) / total
    weight = min(1000.0, max(1.0, m * (1 - m) / v - 1))
    rate = {h: (b + m * weight) / (n + weight) for h, (n, b) in made.items()}
    force = {h: r * (1 - m) >= 0.5 * m * (1 - r) for h, r in rate.items()}
    assert not force["clean"] and force["usual"] and force["tiny"] and force["wild"]
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(docs, ["doc_id"]).collect()}
    for i, text, host in rows:
        assert got[i].kept == (text != marked or not force[host]), host
        assert abs(got[i].host_failure_rate - rate[host]) < 1e-12
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}


def test_host_verdict_rejects_junk_of_the_given_documents(spark):
    docs, labels = table(spark, SF01.replace("sf0.01", "sf0.1"), "documents"), table(spark, SF01.replace("sf0.01", "sf0.1"), "labels")
    rows = quality_rules.quality_verdicts(docs, ["doc_id"]).join(labels, "doc_id", "left").filter("not base_failed and not kept").collect()
    assert len(rows) > 500 and not any(r.quality == 1 for r in rows) and sum(r.quality == 0 for r in rows) > 200


def test_quality_of_an_empty_table(no_docs):
    assert quality_rules.quality_verdicts(no_docs, ["doc_id"]).count() == 0
    assert quality_rules.keep_good(no_docs).columns == no_docs.columns and quality_rules.keep_good(no_docs).count() == 0


def test_chat_folds_events(spark):
    log = [
        (1, 0, 10, "delta", "user", "hel"), (1, 1, 10, "delta", "user", "lo"), (1, 2, 11, "delta", "assistant", "bad"),
        (1, 3, 11, "regenerate", "assistant", None), (1, 4, 11, "delta", "assistant", "<|end|>\n"), (1, 5, 11, "delta", "assistant", "\\l[x"),
        (1, 6, 10, "edit", "user", "Hi"), (1, 7, 10, "delta", "user", "!"), (1, 8, 12, "other", None, "?"), (2, 1, 1, "edit", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string").repartition(3)
    messages = chat.fold_events(events)
    got = {(r.conv_id, r.msg): (r.seq, r.role, r.text) for r in messages.collect()}
    assert got == {(1, 10): (0, "user", "Hi!"), (1, 11): (2, "assistant", "<|end|>\n\\l[x"), (1, 12): (8, None, ""), (2, 1): (1, None, "")}
    back = {r.conv_id: r for r in chat.read_back(chat.render(messages)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "Hi!"), ("assistant", "<|end|>\n\\l[x"), ("", "")]
    assert back[1].loss_text == "<|end|>\n\\l[x" and back[2].loss_text == ""


def test_chat_edges(spark):
    texts = [None, "", chat.TURN, chat.END, "\\", "\\e\\l\\b\\n", "[[<<\n\n", "é🙂" * 2000, "</s>[INST] ok [/INST]"]
    rows = [(c, t, role, x) for c, role in ((1, "assistant"), (2, None), (None, "a\nb<|turn|>")) for t, x in enumerate(texts)]
    rows += [(1, 0, "assistant", None), (1, None, "user", "no turn"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(x for *_, role, x in own if role == "assistant")
        import hashlib

        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_license_edges(spark):
    notice = licenses.NOTICES["GPL-3.0"]
    filler = " ".join(f"w{i}" for i in range(500))
    docs = [(k, " ".join(filler.split()[:k]) + "\n" + notice.upper() + " " + filler) for k in range(20)]
    docs += [(30, licenses.NOTICES["BSD"] + "."), (31, None), (32, ""), (33, "the MIT license"), (None, "Released under the MIT License"), (34, filler)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan_licenses(df).collect()}
    assert {k for k, v in got.items() if k[1] == "GPL-3.0"} == {(k, "GPL-3.0") for k in range(20)}
    assert (30, "BSD") in got and (None, "MIT") in got and not any(k[0] in (31, 32, 33, 34) for k in got)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_bands_guarantee_retrieval():
    for c in licenses.CLASSES:
        jaccard = (c.shortest - licenses.SHINGLE + 1) / c.shingles
        assert (1 - jaccard) ** c.bands <= licenses.MISS
        assert c.stride <= c.words - c.longest + 1


def test_token_counts(edge_docs, edge_rows):
    scores = token_counts.unigram_scores(token_counts.default_path())
    longest = max(map(len, scores))

    def count(word):
        b = token_counts.MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(b) + 1):
            options = [(best[end - k][0] + scores[b[end - k : end]], best[end - k][1] - 1) for k in range(1, min(end, longest) + 1) if b[end - k : end] in scores]
            best.append(max(options))
        return -best[-1][1]

    memo = {}
    want = Counter()
    for r in edge_rows:
        w = (r[1] or "").encode().split()
        want[r[0], len(w), sum(memo.setdefault(x, None) or memo.update({x: count(x)}) or memo[x] for x in w)] += 1
    assert Counter(map(tuple, token_counts.token_counts(edge_docs).collect())) == want


def test_rake_meets_targets_and_sampling(spark, edge_docs, edge_rows):
    docs = edge_docs.filter("doc_id IS NULL OR doc_id < 500")  # the spam is one source and topic: its targets contradict
    rows = mixing.mix(docs).toPandas()
    assert len(rows) == docs.count()
    rows["expected"] = rows.n_tokens * rows.probability
    for m, power in mixing.TEMPERATURES.items():
        natural = rows.groupby(m).n_tokens.sum().astype(float)
        natural = natural[natural > 0]
        target = natural**power / (natural**power).sum()
        got = rows.groupby(m).expected.sum()[target.index]
        assert np.allclose(got / got.sum(), target, rtol=1e-4), m
    assert rows.probability.between(0, 1).all() and np.isclose(rows.probability.max(), 1)
    sampled = mixing.sample_mix(docs)
    assert sampled.columns == edge_docs.columns
    assert Counter(map(str, (r.doc_id for r in sampled.collect()))) == Counter(
        "None" if np.isnan(i) else str(int(i)) for i in rows[rows.sampled].doc_id
    )
    assert mixing.mix(edge_docs).count() == len(edge_rows)


def test_packing_pieces_and_bins(edge_docs, edge_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_path())
    want = Counter()
    for r in edge_rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r[0], p, at, len(part), zlib.crc32(part.tobytes())] += 1
    rows = packing.pack_documents(edge_docs).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_rounds(edge_docs, monkeypatch):
    monkeypatch.setattr(packing, "CELL_PIECES", 16)
    rows = packing.pack_documents(edge_docs).collect()
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(rows) == packing.document_pieces(edge_docs, packing.default_path()).count()


def test_local_search_saves_bins():
    # best fit opens four bins; an exchange closes one
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 60, 120)
        bins = packing.pack(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(120))
        assert max(sum(lengths[i] for i in b) for b in bins) <= 100
        assert len(bins) <= len(packing.best_fit(lengths, 100))


def test_word_bpe_equals_tokenizer():
    import random

    rng = random.Random(3)
    letters = "aAbÉßſİıΣςσé   \x1c\x85\t\n'sS't<|endoftext|>½²ªµ٣漢字🙂_-#ŉǅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["it's <|endoftext|>x", "ΣΑΣ İ'S", "don'T WE'LL", "", "x" * 5000]
    bpe = WordBpe(default_path())
    for first, ids, counts in bpe.slices(texts):
        end = 0
        for k, n in enumerate(counts):
            assert ids[end : end + n].tolist() == bpe.tokenizer.encode(texts[first + k], add_special_tokens=False).ids
            end += n


def test_word_bpe_passes_new_chunks_only_through_python(monkeypatch):
    seen, strings = [], word_bpe._strings
    monkeypatch.setattr(word_bpe, "_strings", lambda array: seen.extend(strings(array)) or strings(array))
    texts = ["One\u00a0two, it's three\u3000é " * 500, "", " \t", "three <|endoftext|>x\x85y"] * 20
    bpe = WordBpe(default_path())
    ((first, ids, counts),) = bpe.slices(pa.array(texts))
    want = [bpe.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[:4]] * 20
    assert first == 0 and counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert 0 < len(seen) < 30
    before = len(seen)
    assert [len(i) for _, i, _ in bpe.slices(pa.array(texts))] == [len(ids)] and len(seen) == before


def test_word_bpe_starts_its_cache_anew(monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE_CHUNKS", 2)
    monkeypatch.setattr(word_bpe, "SLICE_BYTES", 12)
    texts = ["a b c", "b c d e f", "", "one long text that is a slice of its own", "a", "b", "Ω c"]
    bpe = WordBpe(default_path())
    found = list(bpe.slices(pa.array(texts, pa.large_string())))
    assert [f for f, _, _ in found] == [0, 1, 3, 4]
    got = [part.tolist() for _, ids, counts in found for part in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [bpe.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    found = quality_classifier.classify(table(spark, sf, "documents"), labels.filter("doc_id % 2 = 0"))
    held = found.join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    assert ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.98
    assert held[held.quality == 1].kept.mean() > 0.99


def test_classifier_shrinks_sites(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in [*range(60), *range(500, 512)]] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.classify(edge_docs, labels).collect()
    assert len(rows) == len(edge_rows)
    spam = [r for r in rows if r.doc_id is not None and 500 <= r.doc_id < 512]
    others = [r for r in rows if r.doc_id is not None and r.doc_id < 60]
    assert max(r.host_score for r in spam) < min(r.host_score for r in others)
    assert quality_classifier.classify(edge_docs, labels.limit(0)).count() == len(edge_rows)
    assert quality_classifier.classify(no_docs, labels).count() == 0


def test_empty_tables(no_docs):
    assert quality_rules.quality_verdicts(no_docs, ["doc_id"]).count() == 0
    assert token_counts.token_counts(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0 and mixing.sample_mix(no_docs).count() == 0
    assert packing.pack_documents(no_docs).count() == 0
