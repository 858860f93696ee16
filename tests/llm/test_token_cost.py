"""Texts are encoded in few calls, not word by word, with the same ids."""

from __future__ import annotations

import pandas as pd
from hypothesis import given, settings, strategies as st

from flowlens.llm import token_output as tokens

CODER = tokens.Tokenizer(tokens.Layout().ranks())


def test_new_words_cost_no_call_each(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    tasks, calls, plain = [], [], tokens.Tokenizer.plain
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, f, schema: tasks.append(f) or self)
    tokens.sequences(docs, tokens.Layout(length=64))
    monkeypatch.setattr(tokens.Tokenizer, "plain", lambda self, text: calls.append(text) or plain(self, text))
    texts = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(5)]
    rows = pd.DataFrame({"row": range(5), "doc_id": range(5), "text": texts})
    found = pd.concat(tasks[0](iter([rows])))
    assert found["n_tokens"].sum() == sum(len(plain(CODER, t)) // 2 + 1 for t in texts)
    assert len(calls) <= len(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r\x1c\x85\xa0 　ab'sé1.,\U0001f600"), max_size=60), st.integers(1, 20))
def test_cut_texts_have_the_same_ids(text, piece):
    before, tokens.PIECE = tokens.PIECE, piece
    try:
        assert CODER.whole(text) == CODER.plain(text)
    finally:
        tokens.PIECE = before
