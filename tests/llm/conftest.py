from __future__ import annotations

import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table from texts (ids in order), with an extra column of a clashing name."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", "h", len(t or ""), "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string")

    return make
