from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, cls string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def awkward():
    """Nulls, empty and blank texts, a long text, repeated rows and a repeated id."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30000))
    return [(1, None), (2, ""), (3, " \n\t "), (None, "a text without an id of some length"), (4, "same words here"), (4, "same words here"), (5, long), (6, "é ü 日本 words"), (7, "same words here")]
