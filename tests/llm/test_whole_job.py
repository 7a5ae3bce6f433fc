"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import numpy as np
import pytest

from fraudscope.llm import chat, licenses, mixing, packing
from fraudscope.llm.common import table
from tests.conftest import SF01

LICENSE_LINES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "All rights reserved.": "Proprietary",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
}


def test_every_license_line_is_found(spark):
    docs = table(spark, SF01, "documents")
    found = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()}
    want = {(r.doc_id, LICENSE_LINES[x]) for r in docs.collect() for x in (r.text or "").split("\n") if x in LICENSE_LINES}
    assert {x for _, x in want} == set(LICENSE_LINES.values())
    assert want <= found


def test_whole_license_texts_in_long_documents(spark):
    filler = " ".join(f"w{i % 977}" for i in range(40_000))
    mit, words = licenses.NOTICES["MIT-full"], licenses.NOTICES["MIT-full"].split()
    rows = [
        (1, f"{filler} {mit} {filler}"),
        (2, " ".join(words[: len(words) // 2])),  # half a text is not the text
        (3, mit.upper().replace(" ", "\n * ")),
        (4, " ".join(w if i != 60 else "changed" for i, w in enumerate(words))),  # one segment hurt
        (5, licenses.NOTICES["Apache-2.0-header"]),
        (5, licenses.NOTICES["Apache-2.0-header"]),  # a repeated row is reported once
        (6, filler),
    ]
    found = [(r.doc_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(i for i, k in found if k == "MIT-full") == [1, 3, 4]
    assert [i for i, k in found if k == "Apache-2.0-header"] == [5]
    assert {i for i, k in found if k == "MIT-text"} == {1, 2, 3, 4}
    assert not [k for i, k in found if i == 6]


def test_three_word_notice(spark):
    texts = ["All rights reserved.", "x y. ALL RIGHTS\nRESERVED", "rights all reserved", "all rights", "Copyright. All rights reserved worldwide"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license, r.n_windows, r.first_word, r.containment) for r in licenses.scan_licenses(df).collect()}
    assert got == {0: ("Proprietary", 1, 0, 1.0), 1: ("Proprietary", 1, 2, 1.0), 4: ("Proprietary", 1, 1, 1.0)}


def test_local_search_goes_on():
    # without small fillers nearly every bin stays open; taking only the 64 emptiest apart ends at 1225, best fit at 1257
    lengths = np.random.default_rng(1).integers(400, 801, 4096)
    bins = packing.pack(lengths)
    assert sorted(i for b in bins for i in b) == list(range(4096))
    assert max(lengths[b].sum() for b in bins) <= 2048
    assert len(bins) <= 1218


def test_packing_carries_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_PIECES", 256)
    lengths = np.random.default_rng(2).integers(400, 801, 1024).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing._PIECES)
    rows = packing.pack_pieces(pieces).toPandas()
    assert sorted(rows.doc_id) == list(range(1024))
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    alone = rows.sort_values(["sequence_id", "offset"])
    ends = (alone.offset + alone.length).groupby(alone.sequence_id).shift(fill_value=0)
    assert (alone.offset == ends).all()
    # the search of all pieces in one cell ends at 303
    assert rows.sequence_id.nunique() <= 304, rows.sequence_id.nunique()


def test_rake_goes_on_to_tolerance(spark):
    # sources and languages go together: 30 cycles leave an error of 1.3%, 90 less than 1e-6
    tokens = np.where(np.eye(4, dtype=bool), [1_000_000, 300_000, 100_000, 30_000], 1000).tolist()
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", n) for i, r in enumerate(tokens) for j, n in enumerate(r)], "source string, lang string, tokens long")
    targets = {m: mixing.tempered_targets(cells, m, p) for m, p in (("source", 0.7), ("lang", 0.9))}
    got = mixing.rake(cells, targets).toPandas()
    for m, df in targets.items():
        want = df.toPandas().set_index(m).target
        assert np.allclose(got.groupby(m).weight.sum()[want.index], want, rtol=1e-5, atol=0), m
    assert got[["source_error", "lang_error"]].max().max() <= 1e-5


def test_rake_reports_what_is_left(spark):
    # each source has one language, so targets of both contradict
    cells = spark.createDataFrame([("a", "x", 900), ("b", "y", 100)], "source string, lang string, tokens long")
    targets = {m: mixing.tempered_targets(cells, m, p) for m, p in (("source", 0.5), ("lang", 1.0))}
    with pytest.warns(UserWarning, match="source"):
        got = mixing.rake(cells, targets).toPandas().set_index("source")
    assert np.isclose(got.weight["a"], 0.9) and got.lang_error.max() < 1e-9
    assert np.isclose(got.source_error["a"], 0.9 / 0.75 - 1) and np.isclose(got.source_error["b"], 1 - 0.1 / 0.25)


def test_chat_spans_of_a_long_conversation(spark):
    rows = [(None if i % 2 else 1, i // 2, 0, "assistant" if i % 3 else None, "é<" * (i % 7)) for i in range(4000)]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, seq int, msg int, role string, text string")).collect()
    assert len(got) == 2
    for r in got:
        mine = sorted(x for x in rows if x[0] == r.conv_id) if r.conv_id else [x for x in rows if x[0] is None]
        bodies = [r.formatted[s.start - 1 : s.start - 1 + s.length] for s in r.loss_spans]
        assert all(r.formatted[s.start - 1 + s.length :].startswith(chat.END) for s in r.loss_spans)
        assert [b.count("é") for b in bodies] == [x[4].count("é") for x in mine if x[3]]
