from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [
            (i, t, *(rest or ("en", "s")), None if t is None else len(t)) for i, t, *rest in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make
