"""Fits and their scores do not move or make rows anew more often than they have to."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowlens.catalog import model_queries as Q
from flowlens.operators import logistic, reports


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_newton_steps_leave_rows_where_they_are(spark, monkeypatch):
    seen, sums = [], logistic._sums
    monkeypatch.setattr(logistic, "_sums", lambda joined, width: seen.append(plan(joined)) or sums(joined, width))
    rows = [(g, float(i % 7), (i * 5 % 11) / 11.0, int(i % 7 + i % 3 > 4)) for i in range(200) for g in ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double, z double, y int")
    found = logistic.fit_logistic(df, features=["x", "z"], label="y", by="g")
    assert list(found) == ["a", None] and found["a"].weights == pytest.approx(found[None].weights)
    assert len(seen) > 2
    for text in seen:
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", ["train_boosted_trees", "train_mlp"])
def test_models_score_once(spark, monkeypatch, name):
    given, ranked = [], Q.rank_metrics
    monkeypatch.setattr(Q, "rank_metrics", lambda rows, **kw: given.append(plan(rows)) or ranked(rows, **kw))
    out = getattr(Q, name)(spark, "/root/testdata/sf0.001")
    assert given and "UDF" not in given[0] and "FileScan" not in given[0]
    assert out.agg(F.sum("rows") == F.sum("scored")).first()[0]


def test_refit_moves_rows_without_lambdas_and_makes_its_profile_once(spark, monkeypatch):
    plans, cut, profiles, attach = [], reports.cut_lineage, [], reports.attach_profile
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(reports, "cut_lineage", lambda df: plans.append(text(df)) or cut(df))
    monkeypatch.setattr(reports, "attach_profile", lambda df, p, **kw: profiles.append(p.isLocal()) or attach(df, p, **kw))
    out = Q.robust_refit(spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("lambda" in p for p in plans)
    assert profiles == [True] * 4
    assert all(r.decided and r.consistent for r in out.collect())
