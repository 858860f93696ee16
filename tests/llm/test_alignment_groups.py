"""Group ends as arrays, and the printed groups that come from them without a step for each token."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from flowlens.llm import alignment
from tests_llm_data import prose

rising = st.lists(st.integers(1, 60), min_size=1, unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(rising, rising)
def test_last_tokens_of_groups(x, y):
    end = max(x[-1], y[-1]) + 1
    x, y = [*x, end], [*y, end]
    both = sorted(set(x) & set(y))
    a, b = alignment.last_of_groups(np.array(x), np.array(y))
    assert [x[i] for i in a] == both and [y[j] for j in b] == both


def test_long_equal_runs_are_skipped():
    class Watched(list):
        looks = 0

        def __getitem__(self, at):
            Watched.looks += 1
            return super().__getitem__(at)

    x = Watched(range(1, 1 << 16))
    assert list(alignment.stretches(x, list(x))) == [(0, 0, len(x))]
    assert Watched.looks < 64


def test_printed_groups_follow_their_texts():
    coders = [kind(file) for kind, file in zip((alignment.ByteLevel, alignment.Pieces), alignment.Vocabularies().files(), strict=True)]
    rng = random.Random(4)
    for text in [prose(i, rng.randrange(1, 80)) for i in range(20)] + ["x", " ", "日本語 naïve", "a" * 500]:
        found = alignment.aligned(text, *coders)
        if not found.n_a:
            continue
        a, b, bytes_met = [], [], b""
        for group in found.groups.split(";"):
            sides = [[int(i) for i in side.split(",")] for side in group.split("|")]
            met = [b"".join(c.bytes[i] for i in ids) for c, ids in zip(coders, sides, strict=True)]
            assert met[0] == met[1]
            bytes_met += met[0]
            a, b = a + sides[0], b + sides[1]
        assert (a, b) == (coders[0](text), coders[1](text)) and bytes_met == b" " + text.encode()
        assert found.n_groups == found.groups.count(";") + 1 and int(found.links.sum()) == len(a) + len(b) - found.n_groups
    assert hashlib.sha256(alignment.aligned("", *coders).groups.encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
