"""The language model against dictionaries of counts, its levels against sorted arrays."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowlens.llm import language_model as lm
from flowlens.llm.elias_fano import EliasFano
from flowlens.llm.ngram_trie import ANY, Trie, merged
from tests_llm_data import prose


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), max_size=300), st.lists(st.integers(-2, 1 << 41), max_size=50))
def test_elias_fano(values, asked):
    values = np.array(sorted(values), np.int64)
    seq = EliasFano.of(values)
    assert (seq.access(np.arange(len(values))) == values).all()
    x = np.array([*asked, *values[:20], *(values[:20] + 1)], np.int64)
    place, found = seq.successor(x)
    assert (place == np.searchsorted(values, x)).all() and (found == np.isin(x, values)).all()


def test_elias_fano_is_small():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 30, 100_000))
    assert sum(a.nbytes for a in EliasFano.of(values).parts()) < 2.2 * len(values)  # 30 bits each as they are


class Plain:
    """Counts in dictionaries; probabilities by the same smoothing, not quantised."""

    def __init__(self, texts: list[list], discount: float):
        self.d, self.c = discount, collections.Counter(t for x in texts for t in x[2:])
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.after = [collections.defaultdict(collections.Counter) for _ in range(2)]
        for x in texts:
            for i in range(2, len(x)):
                self.after[0][x[i - 1]][x[i]] += 1
                self.after[1][x[i - 2], x[i - 1]][x[i]] += 1

    def p(self, u, v, w) -> float:
        p = (self.c[w] + 1) / (self.n + self.v + 1)
        for level, context in ((0, v), (1, (u, v))):
            seen = self.after[level].get(context)
            if seen:
                total = sum(seen.values())
                p = max(0, seen[w] - self.d) / total + self.d * len(seen) / total * p
        return p


def tokens(text: str | None) -> list:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [0, 1, *(w for w in lower.encode("utf-8", "replace").split()), 2]


def check(docs, rows: list[tuple], model=lm.Model(), parts=3) -> list:
    learned = [tokens(t) for i, t in rows if i is not None and i % 7 != 2]
    plain = Plain(learned, model.discount)
    want = collections.defaultdict(list)
    for i, t in rows:
        x = tokens(t)
        base = sum(math.log10((plain.c[w] + 1) / (plain.n + plain.v + 1)) for w in x[2:])
        score = sum(math.log10(plain.p(*x[k - 2 : k + 1])) for k in range(2, len(x)))
        want[i].append((len(x) - 2, sum(plain.c[w] > 0 for w in x[2:]), base, score))
    learn = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(False))
    got = lm.log_probabilities(docs, learn, model=model).collect()
    assert len(got) == len(rows)
    have = collections.defaultdict(list)
    for r in got:
        assert r.train_tokens == plain.n and r.learned == (r.doc_id is not None and r.doc_id % 7 != 2)
        have[r.doc_id].append((r.n_tokens, r.n_known, r.base_score, r.score))
    assert have.keys() == want.keys()
    for i, texts in want.items():
        for a, b in zip(sorted(texts), sorted(have[i]), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)
            assert abs(a[3] - b[3]) <= 3 * a[0] / 2 / 2048 + 1e-6 * abs(a[3])
    return got


@pytest.fixture(scope="module")
def rows():
    texts = [prose(i, 5 + i % 90) for i in range(120)] + ["Same Words here"] * 60 + ["x y z " * 40, "x Y q " * 60, None, "", "  ", "only"]
    return list(enumerate(texts)) + [(None, prose(3, 20)), (2, prose(900, 50)), (9, "zzz unknown yyy"), (9, prose(5, 400))]


def test_equals_dictionaries(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(docs, rows)


def test_many_shards_frequent_words_and_joined_numbers(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    real = lm.loads
    monkeypatch.setattr(lm, "loads", lambda *a: seen.append(real(*a)) or seen[-1])
    a = check(docs, rows, lm.Model(batch=600, per_shard=250))
    b = check(docs, rows, lm.Model(batch=3000, per_shard=150, max_shared=0, discount=0.5))
    assert len(a) == len(b) and any(seen)  # a frequent pair of words was shared by several tasks


def test_probabilities_add_up():
    rng = np.random.default_rng(2)
    line = rng.zipf(1.5, 4000).clip(max=40) + 2
    parts = merged([(line[1:-1], line[:-2], line[2:], np.ones(len(line) - 2, np.int64))])
    words = np.arange(3, 44)
    p1 = np.bincount(line, minlength=44)[words] + 1.0
    p1 /= p1.sum()
    v, u, w, n = parts
    trie = Trie.of(v, u, w, n, lambda x: p1[x - 3], 0.75).mapped()
    for a, b in ((line[0], line[1]), (3, 4), (43, 3), (3, 44)):
        total = (10 ** trie.score(np.full(41, a), np.full(41, b), words, p1)).sum()
        assert total == pytest.approx(1, abs=2e-3)
    # a middle word in parts, each of which knows its pairs, scores as one whole
    hot = v == 3
    pairs = merged([(v[hot], w[hot], w[hot], n[hot])])
    for part in range(2):
        mine = hot & (u % 2 == part)
        known = merged([(v[mine], u[mine], w[mine], n[mine]), (pairs[0], np.full(len(pairs[0]), ANY), pairs[1], pairs[3])])
        split = Trie.of(*known, lambda x: p1[x - 3], 0.75)
        at = np.flatnonzero((line[1:-1] == 3) & (line[:-2] % 2 == part))
        args = line[at], line[at + 1], line[at + 2], p1[line[at + 2] - 3]
        assert (split.score(*args) == trie.score(*args)).all()


def test_word_hashes_that_clash_are_made_anew(spark, rows, monkeypatch):
    real = lm.xxhash.xxh3_128_digest

    class Clashing:
        @staticmethod
        def xxh3_128_digest(word: bytes, seed: int) -> bytes:
            return (b"\1" * 8 if seed == 42 and word in (b"the", b"of") else real(word, seed)[:8]) + real(word, seed)[8:]

    monkeypatch.setattr(lm, "xxhash", Clashing)
    docs = spark.createDataFrame(rows[:40], "doc_id long, text string")
    check(docs, rows[:40])


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    check(odd, [(r.doc_id, r.text) for r in odd.collect()])
    assert lm.log_probabilities(nothing, F.lit(True)).count() == 0
    got = lm.log_probabilities(odd.withColumn("doc_id", F.col("text")), F.lit(None).cast("boolean")).collect()
    assert {r.n_known for r in got} == {0} and {r.train_tokens for r in got} == {0} and all(r.base_score == r.score == 0 for r in got)
