"""What the language model's tasks hold at once: small batches of texts, few copies of a shard's rows."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import language_model as lm
from flowlens.llm.common import BATCH_BYTES
from flowlens.llm.ngram_trie import Trie, merged
from tests_llm_data import prose


def test_texts_go_to_python_in_small_batches(spark):
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.unset(BATCH_BYTES)
    try:
        docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(4)], "doc_id long, text string")
        assert lm.log_probabilities(docs, F.lit(True)).count() == 4
        assert spark.conf.get(BATCH_BYTES, None) == "4m"
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def test_a_trie_is_made_from_few_copies_of_its_rows():
    rng = np.random.default_rng(3)
    rows = [rng.integers(3, 5000, 300_000).astype(np.uint32) for _ in range(3)]
    tracemalloc.start()
    try:
        trie = Trie.of(*merged([(*rows, np.ones(300_000, np.uint32))]), lambda x: np.full(len(x), 1e-4), 0.75)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert trie.p_then.size > 299_000 and peak < 160 * 300_000
