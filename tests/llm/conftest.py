from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, host string, topic string"


@pytest.fixture(scope="session")
def edge_rows():
    """NULLs in every column, empty and very long texts, near copies, ties, repeated rows; columns with common names."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = prose(300)
    words = base.split()
    rows = [(i, prose(rng.randint(1, 200)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), i) for i in range(60)]
    rows += [(100 + i, " ".join(words[:k] + ["new" + str(i)] + words[k + 1 :]), "en", "a", None) for i, k in enumerate(range(10, 210, 10))]
    rows += [(200, base, "en", "a", 1), (201, base.replace(" ", " \t\n"), "fr", "b", 1), (200, base, "en", "a", 1)]
    rows += [(300, None, "en", "a", 0), (301, "", None, None, None), (302, " \n\t ", "en", "a", 3), (None, None, None, None, None)]
    rows += [(None, base, "en", "a", 1), (None, prose(80), "en", "a", 1), (7, prose(60), "de", "c", 1)]
    rows += [(400, prose(30_000), "en", "c", 1), (401, "x" * 50_000, "en", "c", 1), (402, "one two", "en", "c", 1), (403, "one two", "en", "c", 1)]
    rows += [(500 + i, " ".join(w + "%%#" for w in prose(90).split()) + f" {i}", "en", "spam", 1) for i in range(12)]
    return [(*r, "r", "h", "t") for r in rows]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
