"""Small document tables with the awkward rows that every operator must take."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, score double, _row string, queue string"


def document_rows():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    long = " ".join(words[i % 12] + str(i // 7) if i % 9 else "the" for i in range(3000))
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, "   \n\t ", None, None),
        (4, "one", "en", "a"),
        (5, " ".join(words), "en", "b"),
        (6, " ".join(words), "en", "b"),
        (6, " ".join(words), "en", "b"),
        (7, long, "en", "a"),
        (8, long + " tail", "fr", "a"),
        (9, "ÄÖÜ straße naïve cóte ÇA 12 3.5 it's <|endoftext|> x\x1cy z 日本語", "de", None),
        (None, "a row without an id but with ten words or a few more", None, "c"),
        (10, "x" * 5000, "en", "a"),
        (11, "!!! ??? ###", "en", "a"),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, lang, s, 0.5, "clash", "clash") for i, t, lang, s in document_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
