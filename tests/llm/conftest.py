"""Odd tables that every operator has to take."""

from __future__ import annotations

import pytest
from tests_llm_data import prose

COLUMNS = "doc_id long, text string, lang string, source string, row string, key int, shard string, language string, Copies int"


def odd_rows() -> list[tuple]:
    long = prose(7, 30_000)
    texts = [
        (1, prose(1, 120)), (2, prose(1, 120)), (3, None), (4, ""), (5, "   \n\t "), (None, prose(2, 80)), (None, None),
        (6, long), (7, "é" * 300), (8, "x"), (8, "x"), (9, "Word word WORD"), (10, prose(3, 60).upper()), (11, "1 2 3 4"),
        (12, " a b\u0085c"), (13, prose(4, 200) + "\U0001f600"), (14, "a" * 70_000), (8, prose(5, 40)),
    ]
    langs, sources = ["en", None, "de"], ["a", None, "b", ""]
    return [
        (i, t, langs[n % 3], sources[n % 4], "r", n, "s", "l", None if n % 2 else n) for n, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3, "key")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
