"""Tables of odd rows: NULLs, empty and very long texts, ties, repeated rows, and columns whose names clash."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, label int, score double, key long, node long, component long, h long, s_words double, _text string, place double"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one two"),
    (5, "One  TWO"),
    (6, BASE),
    (7, BASE + " one"),
    (8, BASE.upper()),
    (9, " ".join(f"w{k % 977}x{k // 977}" for k in range(20_000))),
    (10, "a" * 30_000),
    (11, "Zürich   ñandú 東京 \U0001f600 it's 42!!  \n\n x"),
    (None, BASE),
    (12, BASE),
    (12, BASE),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 4}", len(t or ""), 9, 1, 0.5, 3, 4, 5, 6, 0.1, "z", 0.2) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1 if i % 2 else 0, 1 if i % 3 == 0 else 0) for i in range(1, 13)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
