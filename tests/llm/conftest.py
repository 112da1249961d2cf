from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, or from (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(k, r, "en", f"s{k % 3}") if r is None or isinstance(r, str) else r for k, r in enumerate(rows)]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCS)

    return make


#: Nulls everywhere, empty and blank texts, ties, repeated rows and a very long text.
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", None, "a"),
    (4, "one two", "en", None),
    (4, "one two", "en", None),
    (None, "one two three four five six", "en", "b"),
    (None, None, None, None),
    (5, "word " * 60_000, "en", "b"),
    (6, "x" * 200_000, "en", "b"),
    (7, "line\n" * 500, "de", "a"),
    (8, "Ünïcödé 文字 \U0001f600 <|endoftext|> a\x00b", "de", "c"),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(docs_of, spark):
    return spark.createDataFrame([], DOCS)
