from __future__ import annotations

import pytest

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, fp string, row string, kept string, size string, score string, key string, n int"


def documents(spark, rows):
    """doc_id, text and optionally lang, source; with more columns whose names the operators use themselves."""
    full = [(*r, *(None,) * (4 - len(r)), None, "u", "f", "r", "k", "s", "c", "y", 1) for r in rows]
    return spark.createDataFrame(full, KIND)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, repeated rows, ties, a long text, text without letters."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(60000))
    return make([
        (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "b"), (2, "ALPHA beta gamma delta epsilon zeta eta theta", "en", "a"), (3, None, "en", "a"), (4, "", None, None),
        (5, " \n\t ", "fr", None), (6, "été à la plage", "fr", "a"), (7, long, "en", "b"), (8, long + " end", "en", "b"), (9, "123 !!", None, "a"), (9, "123 !!", None, "a"), (10, "one two", "en", "é"), (None, "one two", None, "b"),
    ])


@pytest.fixture(scope="session")
def empty(make):
    return make([])
