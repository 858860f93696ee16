"""Near-duplicates of the pipeline against plain sets of five-word runs."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
from flowlens.llm import minhash, simhash
from tests_llm_data import WORD, prose


def runs(text: str | None) -> frozenset:
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_groups(texts: list) -> list[int]:
    sets, parent = [runs(t) for t in texts], list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def edited(text: str, words: int, rng: random.Random) -> str:
    w = text.split()
    for i in rng.sample(range(len(w)), words):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


def test_the_stage_drops_texts_with_a_few_words_edited(spark):
    rng = random.Random(3)
    bases = [prose(s, 200) for s in range(12)]
    texts = bases + [edited(b, n % 7, rng) for n, b in enumerate(bases)]
    texts += [edited(bases[0], rng.randrange(1, 9), rng) for _ in range(40)]  # a large group, part of it too far
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = plain_groups(texts)
    want = sorted({g: min(i for i, x in enumerate(groups) if x == g) for g in groups}.values())
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert simhash.deduplicate(docs).count() > len(want)


def test_large_groups_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 6)
    rng = random.Random(8)
    bases = [prose(s, 120) for s in (50, 51)]
    texts = [edited(bases[n % 2], rng.randrange(1, 7), rng) for n in range(150)] + bases[:1]  # many a little less similar than 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = plain_groups(texts)
    want = {i: min(j for j, x in enumerate(groups) if x == g) for i, g in enumerate(groups)}
    assert 5 < len(set(want.values())) < 120
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == want


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    rows = odd.select("doc_id", "text").collect()
    assert minhash.deduplicate(odd).count() == len(set(plain_groups([r.text for r in rows])))
    assert minhash.near_duplicates(odd).count() == len(rows)
    assert minhash.deduplicate(nothing).count() == 0
