from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, stays string"  # one extra column that clashes


@pytest.fixture()
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, an extra column."""
    long_text = "Lange Wörter und the quick brown fox jumps over it. " * 30_000
    rows = [(1, "the cat sat on the mat and looked at the dog"), (2, "the  cat sat\non the mat and looked at the dog"), (3, None), (4, ""),
            (None, "no id here at all, just words"), (None, "no id here at all, just words"), (None, None), (5, long_text), (6, long_text), (7, " \t\n"),
            (8, "one two"), (8, "one two"), (8, "another text of the same id"), (9, "漢字 İstanbul ſ é́ <|endoftext|> 'LL we've")]
    return spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in rows], DOCS)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
