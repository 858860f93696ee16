"""Whole texts go to Python in small batches, whose size changes no result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pytest

from flowlens.llm import decontaminate, langid, minhash, token_output as tokens
from flowlens.llm.common import BATCH_BYTES
from tests_llm_data import prose

OPERATORS = {
    "language": lambda docs: langid.identify(docs, langid.LanguageModel()),
    "near_duplicates": minhash.near_duplicates,
    "benchmark_leaks": lambda docs: decontaminate.leaks(docs, docs.selectExpr("doc_id as item_id", "text")),
    "tokens": tokens.training_order,
}


@pytest.fixture
def unset(spark):
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.unset(BATCH_BYTES)
    yield
    spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


@pytest.mark.parametrize("name", OPERATORS)
def test_a_partition_of_texts_is_many_batches(spark, unset, name):
    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [batch["text"].str.len().sum()]})

    few = spark.createDataFrame([(i, prose(i, 30)) for i in range(4)], "doc_id long, text string")
    OPERATORS[name](few).count()
    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('0123456789abcdef', 256) as text")  # 12 MB
    seen = [r.n for r in texts.mapInPandas(sizes, "n long").collect()]
    assert sum(seen) == 3000 * 4096 and max(seen) <= 5 << 20


def test_a_limit_of_the_session_stays(spark, unset):
    spark.conf.set(BATCH_BYTES, "2m")
    tokens.training_order(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert spark.conf.get(BATCH_BYTES) == "2m"


def test_batches_and_kept_words_change_no_tokens(spark, unset):
    docs = spark.createDataFrame([(i, prose(i, 200)) for i in range(40)], "doc_id long, text string").coalesce(1).cache()
    layout = tokens.Layout(length=32, per_shard=10)
    spark.conf.set(BATCH_BYTES, "64m")
    whole = sorted(tokens.training_order(docs, layout).collect())
    spark.conf.set(BATCH_BYTES, "2k")
    assert sorted(tokens.training_order(docs, layout).collect()) == whole and whole


def test_a_full_store_of_words_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 3)
    monkeypatch.setattr(decontaminate, "KNOWN", 3)
    text = " ".join(f"word{i % 7} other" for i in range(50))
    coder, known = tokens.Tokenizer(tokens.Layout().ranks()), decontaminate.TokenHashes()
    assert coder.encode(text) == coder.plain(text) and len(coder.known) <= 3
    hashes = known.of(text)
    assert len(known) <= 3 and np.array_equal(hashes, decontaminate.TokenHashes().of(text))
