from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with two clashing columns."""

    def make(*rows):
        data = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4] if len(row) == 2 else row
            data.append((doc_id, text, lang, source, len(text or ""), "own size", "own kept"))
        return spark.createDataFrame(data, DOCS)

    return make


#: Rows that every operator must take: NULLs, empty and long texts, ties and repeated rows.
ODD = (
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "one"),
    (5, "one"),
    (None, "a text without a number"),
    (None, None),
    (6, "word " * 30_000),
    (7, "x" * 50_000),
    (8, "Straße, naïve 𝄞 clef\n\ntwo  blanks " * 40),
)
