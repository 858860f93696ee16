"""SimHash groups and benchmark leaks against plain versions."""

from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from flowlens.llm import decontaminate as leaks, simhash
from flowlens.llm.components import components
from tests_llm_data import WORD, prose


def plain_print(text: str | None) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(ids: list, prints: list[int]) -> list:
    parent = list(range(len(prints)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            parent[root(i)] = root(j)
    low = collections.defaultdict(list)
    for i, x in enumerate(ids):
        if x is not None:
            low[root(i)].append(x)
    return [min(low[root(i)], default=None) for i in range(len(ids))]


def test_masks_cover_every_pair():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for a, b in itertools.combinations_with_replacement(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_groups_match_a_plain_version(spark, odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    texts = odd.select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in texts]
    want = collections.Counter(zip([r.doc_id for r in texts], prints, plain_classes([r.doc_id for r in texts], prints), strict=True))
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(plain_classes(list(range(len(prints))), prints)))
    assert simhash.deduplicate(nothing).count() == 0


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(4)
    prints = []
    for _ in range(40):
        centre = rng.getrandbits(64)
        chain = [centre]
        for _ in range(rng.randrange(6)):
            chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        prints += chain
    centre = rng.getrandbits(64)  # a crowd in one bucket
    prints += [centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 7) for b in range(3, 64, 7)]
    prints = sorted(set(prints))
    table = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long")
    named = {r.node: r.component for r in components(simhash.links(table)).collect()}
    want = plain_classes(prints, prints)
    groups = collections.defaultdict(set)
    for x, c in zip(prints, want, strict=True):
        groups[c].add(named.get(simhash.signed(x), simhash.signed(x)))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set.union(*groups.values())) == len(groups)


def test_components_of_a_path_and_a_star(spark):
    n = 60
    order = random.Random(1).sample(range(n), n)
    edges = list(itertools.pairwise(order)) + [(1000, 1000 + i) for i in range(1, 40)] + [(5000, 5000), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[x] for x in range(n)}) == 1 and len({got[1000 + i] for i in range(40)}) == 1
    assert got[0] != got[1000] and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_tiles(text: list[int], test: list[int], least: int) -> list[int]:
    """Lengths of the tiles of plain greedy string tiling."""
    a, b, out = [False] * len(text), [False] * len(test), []
    while True:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(text)), range(len(test))):
            n = 0
            while i + n < len(text) and j + n < len(test) and text[i + n] == test[j + n] and not a[i + n] and not b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        a[i : i + n] = [True] * n
        b[j : j + n] = [True] * n
        out.append(n)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(1, 4), max_size=16))
def test_tiles_are_greedy(text, test):
    tiles = leaks.tile(np.array(text, np.uint64), np.array(test, np.uint64), 3)
    used = [i for t, _, n in tiles for i in range(t, t + n)] + [-1 - i for _, p, n in tiles for i in range(p, p + n)]
    assert len(used) == len(set(used))
    assert all(text[t : t + n] == test[p : p + n] and n >= 3 for t, p, n in tiles)
    # the first tile is the longest match; no further match fits beside them
    want = plain_tiles(text, test, 3)
    assert max((n for *_, n in tiles), default=0) == max(want, default=0)
    a, b = set(x for x in used if x >= 0), set(-1 - x for x in used if x < 0)
    for i, j in itertools.product(range(len(text) - 2), range(len(test) - 2)):
        if text[i : i + 3] == test[j : j + 3]:
            assert a & {i, i + 1, i + 2} or b & {j, j + 1, j + 2}


@pytest.mark.parametrize("size", [1, 5, 16, 17, 64, 131])
def test_windows_with_equal_tokens_hash_equal(size):
    tokens = np.random.default_rng(2).integers(0, 1 << 62, 200, dtype=np.uint64)
    twice = np.concatenate([tokens, tokens])
    hashes = leaks.karp_rabin(twice, size)
    assert len(hashes) == 401 - size and hashes[0] == hashes[200] and len(set(hashes[:200].tolist())) == 200


def test_leaks_in_any_order(spark, odd, nothing):
    test = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = test.split()
    moved = " ".join(w[12:] + ["and", "so"] + w[:6] + ["or"] + w[6:12])
    third = " ".join(w[:6])
    docs = [
        (1, f"{prose(1, 40)} {test.upper()}, {prose(2, 40)}"), (2, f"{prose(3, 50)} {moved}. {prose(4, 9)}"), (3, f"{third} {prose(5, 60)}"),
        (4, " ".join(reversed(w))), (5, prose(6, 500)), (None, test), (6, None), (1, f"{prose(1, 40)} {test.upper()}, {prose(2, 40)}"),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", leaks.F.lit("x"))
    marks = spark.createDataFrame(
        [(7, test), (8, test.title()), (None, None), (9, "too short"), (10, ""), (11, prose(99, 30))], "item_id long, text string"
    )
    found = {r.doc_id: r for r in leaks.leaks(table, marks).collect()}
    assert set(found) == {1, 2, None}
    assert all(r.item_id == 7 and r.n_items == 2 and r.coverage == 1.0 and r.item_words == 20 for r in found.values())
    assert len(found[2].tiles.split(",")) == 3 and found[None].tiles == "0:0:20"
    kept = leaks.decontaminate(table, marks)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert leaks.leaks(odd, marks).count() == 0 and leaks.decontaminate(odd, marks).count() == odd.count()
    assert leaks.leaks(nothing, marks).count() == 0
    assert leaks.leaks(table, marks.limit(0)).count() == 0
