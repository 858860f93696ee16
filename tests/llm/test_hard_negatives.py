"""Hard negatives against a plain version over all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.llm import hard_negatives
from flowlens.llm.hard_negatives import Mining

SCHEMA = "vec_id long, label int, embedding array<float>, no string, id int, g int, windows string"


def plain(rows: list[tuple], mining: Mining = Mining()) -> list[tuple]:
    ok = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for n, (i, label, v) in enumerate(ok):
        if i % 10:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for m, (j, other, w) in enumerate(ok) if m != n]
        scored.sort(key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2] == label][: mining.positives]:
            fits = [x for x in scored if x[2] != label and mining.low * -s <= -100 * x[0] <= mining.high * -s]
            out += [(i, p, r, q, -s, -t) for r, (t, q, _) in enumerate(fits[: mining.negatives], 1)]
    return sorted(out)


def mined(spark, rows, mining=Mining(), parts=3):
    df = spark.createDataFrame([(*r, "a", 1, 2, "w") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, mining).collect())


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    rows = []
    for i in range(400):
        at = rng.randrange(3)
        rows.append((i, rng.randrange(4), [float(f"{rng.gauss(1 if d == at else 0, 0.4):.2f}") for d in range(6)]))
    copies = [(i, i % 3, [0.5, 1.0]) for i in range(1000, 1040)]  # ties by id, vectors that are shorter
    odd = [(None, 1, [1.0] * 6), (50, None, [1.0] * 6), (60, 1, None), (70, 1, [1.0, None]), (80, 1, [float("nan")]), (90, 2, [float("inf")]),
           (2000, 1, []), (2010, 1, [0.0] * 6), (20, 1, [1.0] * 6), (20, 2, [1.0] * 6), (2020, 3, [1.0] * 6), (2020, 3, [1.0] * 6)]
    return rows + copies + odd


def test_equals_all_pairs(spark, vectors, monkeypatch):
    want = plain(vectors)
    assert len(want) > 500
    assert mined(spark, vectors) == want
    other = Mining(positives=2, negatives=9, low=50, high=90)
    assert mined(spark, vectors, other, 1) == plain(vectors, other)


def test_many_blocks(spark, vectors, monkeypatch):
    for name, value in (("ROWS", 16), ("ANCHORS", 8), ("TILE", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(spark, vectors, parts=4) == plain(vectors)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(10, 1, [2e6, 1.0]), (1, 1, [2e6, 0.5]), (2, 2, [2e6, 0.25]), (3, 2, [2e6, 0.75]), (4, 2, [1.75e6, 9.0])]
    assert mined(spark, rows) == plain(rows) and len(plain(rows)) == 2
    huge = [(10, 1, [3e30]), (1, 1, [3e30]), (2, 2, [2e30])]  # beyond a long: all at its end
    assert mined(spark, huge) == [(10, 1, 1, 2, hard_negatives.LONG, hard_negatives.LONG)]


def test_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(10, 1, [1.0]), (11, 2, [1.0])]) == []
    with pytest.raises(ValueError):
        mined(spark, [], Mining(high=101))
