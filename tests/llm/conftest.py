import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, component_id string, n_words string, score string, host string, n_lines string, media string, licenses string, payload string, id string, band string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text, source); every other column, some named like an operator's, holds junk or null."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, s, None, 7, "k", None, "x", "y", None, "z", None, "q", "p", "i", "b") for i, t, s in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, copies and odd characters."""
    base = prose(1, 120)
    edited = " ".join("changed" if i == 60 else w for i, w in enumerate(base.split()))
    rows = [
        (1, None, None), (2, "", "a"), (3, "   \n\t ", "a"), (4, base, "a"), (5, base, None), (6, base.upper(), "b"), (7, edited, "b"), (7, edited, "b"), (None, "text without id", "b"),
        (8, prose(2, 60_000, 9000), "c"), (9, "one", "c"), (10, "ONE", "c"), (11, "naïve café 東京 \x00 \U0001f600", "é"), (12, "a\nb\nc\nd", "b"), (13, "x\na\nb\nc", "b"), (14, "x" * 200_000, "c"), (15, base + "\n" + prose(3, 300), "b"),
    ]
    return make_docs(rows)
