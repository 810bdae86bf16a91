from __future__ import annotations

import os
import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def have_tables():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts() -> list[str | None]:
    """Null, empty, white space only, short, very long, one long word, signs of many scripts, and repeats."""
    rng = random.Random(4)
    long = words(rng, 30_000)
    return [None, "", "  \n\t ", "one", "one two", "x" * 3000, "é中文 ' 's don't\x00\x1c ²½", long, long, "a b c d e f", "A B C D E F", "\U0001f600" * 50]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    rows = [(i, t, None, "s", None) for i, t in enumerate(odd_texts)] + [(None, "no id at all", None, None, None), (9, "a b c d e f", None, "s", None)]
    return spark.createDataFrame(rows, DOCS + "").selectExpr("*", "'x' AS score", "1 AS predicted", "2 AS ids", "'k' AS node", "0 AS key", "3 AS n_tokens", "'d' AS digest")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
