"""Places in turn against sorted rows, for one level and two."""

from __future__ import annotations

import hashlib
import random
from itertools import groupby

import pytest

from flowlens.operators import replay
from flowlens.plans import turns


def plain_hash(text: str, seed: int) -> int:
    return int(hashlib.md5(f"{text}#{seed}".encode()).hexdigest()[:15], 16)


def numbered(rows: list, key) -> dict:
    """Rows with their number in each run of ``key``."""
    out = {}
    for _, run in groupby(sorted(rows, key=lambda r: (key(r), r[2])), key=key):
        out |= {r[2]: n for n, r in enumerate(run, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    sizes = [1, 1, 2, 5, 5, 40, 3, 90, 17]
    rows = [(f"p{g % 3}", f"s{g // 2}", 0) for g, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(rows)
    return [(p, s, i * 3) for i, (p, s, _) in enumerate(rows)]


@pytest.mark.parametrize("few", [True, False])
def test_places_follow_from_sizes(spark, rows, few, monkeypatch):
    if not few:
        monkeypatch.setattr(turns, "pinned", lambda df: df)  # as for more groups than are pinned
    df = spark.createDataFrame(rows, "p string, s string, i long")
    turn = numbered(rows, lambda r: r[1])
    order = sorted(rows, key=lambda r: (turn[r[2]], plain_hash(r[1], 4), r[1]))
    got = replay.interleave(df, by=["s"], order=["i"], seed=4).collect()
    assert {r.i: r.replay_pos for r in got} == {r[2]: n for n, r in enumerate(order, 1)}

    turn = numbered(rows, lambda r: (r[0], r[1]))
    step = {}
    for p in sorted({r[0] for r in rows}):
        inside = sorted((r for r in rows if r[0] == p), key=lambda r: (turn[r[2]], plain_hash(r[1], 4), r[1]))
        step |= {r[2]: n for n, r in enumerate(inside, 1)}
    order = sorted(rows, key=lambda r: (step[r[2]], plain_hash(r[0], 4), r[0]))
    got = replay.interleave_nested(df, outer="p", inner="s", order=["i"], seed=4).collect()
    assert {r.i: r.replay_pos for r in got} == {r[2]: n for n, r in enumerate(order, 1)}


def test_groups_without_a_name_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "s string, i long")
    got = replay.interleave(df, by=["s"], order=["i"], seed=1).collect()
    assert sorted(r.replay_pos for r in got) == [1, 2, 3] and {r.i: r.replay_pos for r in got}[2] == 3
    assert replay.interleave(df.where("i > 9"), by=["s"], order=["i"], seed=1).count() == 0
