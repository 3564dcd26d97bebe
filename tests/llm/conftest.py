from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs."""

    def build(*rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, one long text, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    return make((1, None), (2, ""), (3, " \t\n"), (4, long), (5, "same text of a few words here"), (6, "same text of a few words here"), (6, "same text of a few words here"), (None, "no id at all but some words"), (None, None))
