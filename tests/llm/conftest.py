import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

PASSAGE = "the quick brown fox jumps over the lazy dog and then it runs back to the small green house near the old river bank"
#: Nulls, empty and blank texts, copies, near copies, repeated rows, a null id, a very long text, characters of two and four bytes.
DOCS = [
    (1, PASSAGE + " alpha"),
    (2, PASSAGE + " alpha"),
    (3, "before " + PASSAGE + " after"),
    (3, "before " + PASSAGE + " after"),
    (4, None),
    (5, ""),
    (6, " \t\n "),
    (7, "one"),
    (8, "ONE"),
    (9, "é😀 " * 40 + PASSAGE),
    (10, "x y " * 30_000),
    (11, "a" * 120_000),
    (12, "a" * 60 + " " + PASSAGE.upper()),
    (13, "1234 5678 !!!"),
    (None, PASSAGE + " alpha"),
    (None, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above, with columns whose names the operators use themselves."""
    rows = [(d, t, "en" if i % 2 else None, f"s{i}", None if i % 3 else len(t or ""), i) for i, (d, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")


@pytest.fixture(scope="session")
def known():
    """Edge rows with an id, once each."""
    return list({d: (d, t) for d, t in DOCS if d is not None}.values())


@pytest.fixture(scope="session")
def small(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")
