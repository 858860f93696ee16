"""Quantiles of many columns against sorted values."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.plans import quantiles

PROBS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def plain(values: list[float], p: float) -> float:
    order = sorted(values, key=lambda v: (math.isnan(v), v))
    pos = p * (len(order) - 1)
    lo, hi = order[math.floor(pos)], order[math.ceil(pos)]
    return lo + (hi - lo) * (pos - math.floor(pos))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(3000):
        g = [None, "a", "b"][min(2, i % 7)]
        odd = float("nan") if i % 500 == 0 else float("inf") if i % 700 == 0 else rng.gauss(0, 9)
        out.append((g, rng.lognormvariate(0, 2), float(rng.choice([0, 0, 0, 1, 5])), odd, None if i % 3 else float(i), None))
    return out


@pytest.mark.parametrize("how", ["plain", "missed", "spread"])
def test_equal_sorted_values(spark, rows, how, monkeypatch):
    if how == "missed":
        monkeypatch.setattr(quantiles, "MARGIN", -0.2)  # brackets that hold nothing
    if how == "spread":
        monkeypatch.setattr(quantiles, "pinned", lambda df: df)  # as if much were inside the brackets
    df = spark.createDataFrame(rows, "g string, wide double, ties double, odd double, gaps double, none double").repartition(5)
    names = ["wide", "ties", "odd", "gaps", "none"]
    got = quantiles.wide_quantiles(df, ["g"], {c: F.col(c) for c in names}, PROBS).collect()
    seen = set()
    for r in got:
        values = [x for x in (row[1 + names.index(r.feature)] for row in rows if row[0] == r.g) if x is not None]
        assert r.n == len(values)
        for c, p in PROBS.items():
            want = plain(values, p)
            assert r[c] == pytest.approx(want, nan_ok=True), (r.g, r.feature, c)
        seen.add((r.g, r.feature))
    assert seen == {(g, c) for g in (None, "a", "b") for c in names if c != "none"}


def test_no_groups_and_no_rows(spark, rows):
    df = spark.createDataFrame([(r[1],) for r in rows], "wide double")
    (r,) = quantiles.wide_quantiles(df, [], {"wide": F.col("wide")}, {"q": 0.25}).collect()
    assert (r.feature, r.n, r.q) == ("wide", 3000, pytest.approx(plain([x[1] for x in rows], 0.25)))
    assert r.min_value == min(x[1] for x in rows) and r.max_value == max(x[1] for x in rows)
    assert quantiles.wide_quantiles(df.where("wide < 0"), [], {"wide": F.col("wide")}, {"q": 0.5}).count() == 0


def test_no_exchange_carries_a_row_for_each_value(spark):
    df = spark.range(0, 200_000, 1, 4).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    kept = []
    real = quantiles.pinned
    try:
        quantiles.pinned = lambda x: kept.append(real(x)) or kept[-1]
        quantiles.wide_quantiles(df, [], {"a": F.col("a"), "b": F.col("b")}, {"q": 0.5}).collect()
    finally:
        quantiles.pinned = real
    assert before == spark.conf.get("spark.sql.adaptive.enabled")
    assert max(x.count() for x in kept) < 2 * 200_000 * 3 * quantiles.MARGIN
