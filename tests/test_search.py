"""A search step is compiled, draws what its hashes say, and reads the flows once."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from flowlens.catalog import perturb_queries as Q
from flowlens.operators import search


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_step_is_free_of_lambdas_and_draws_as_documented(spark, monkeypatch):
    plans, cut = [], search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df: plans.append(plan(df)) or cut(df))
    # one key is NULL, one row has its first feature locked
    rows = [(k, [5.0, 5.0], [0.0] * 2, [10.0] * 2, [10.0] * 2, [9.0] * 2, [k == 3, False]) for k in (1, 2, 3, None)]
    df = spark.createDataFrame(
        rows,
        "id int, x array<double>, p_lower array<double>, p_upper array<double>, p_span array<double>, p_cap array<double>, "
        "p_locked array<boolean>",
    )
    p = search.SearchPlan(eps=0.1, budget=5, steps=1, candidates=3, subset=1, refine=2, objective="maximize")
    out, _ = search.hill_climb(df, key="id", x="x", n=2, margin=lambda v: F.get(v, F.lit(0)) + 2 * F.get(v, F.lit(1)) - 99, plan=p)
    got = {r.id: r for r in out.collect()}
    assert plans and not any("lambda" in text for text in plans)

    def unit(*parts) -> float:
        text = "#".join(str(x) for x in (*parts, p.seed) if x is not None)
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) / float(1 << 60)

    for k, r in got.items():
        free, best = [1] if k == 3 else [0, 1], [5.0, 5.0]
        for c in (1, 2, 3):
            i = min(free, key=lambda i: unit(k, 0, c, i))
            size, sign = 0.35 + 0.65 * unit(k, 0, c, i, "size"), 1 if unit(k, 0, c, i, "sign") < 0.65 else -1
            x = [5.0, 5.0]
            x[i] += sign * size
            best = max(best, x, key=lambda v: v[0] + 2 * v[1])
        assert r.x_cur == pytest.approx(best) and r.queries == 5


def test_constraints_of_attacked_rows_read_stored_rows(spark, monkeypatch):
    seen, made = [], Q.C.feature_constraints
    monkeypatch.setattr(Q.C, "feature_constraints", lambda df, **kw: seen.append(plan(df)) or made(df, **kw))
    Q.adv_rows(spark, "/root/testdata/sf0.001")
    assert seen and "parquet" not in seen[0]
