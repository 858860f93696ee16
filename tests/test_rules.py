"""Fixtures for threshold choice, splits, samples, capture statistics, decisions and published counts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.hashing import md5_bucket
from flowlens.operators import combine, constraints, decide, metrics, profile, rank_metrics, sample, search, split, thresholds
from flowlens.schema import METADATA_COLUMNS, feature_columns


def gate(spark, y, clean, benign, malicious, points, base, clean_max, attacked_max, recall, margin=1.0):
    rows = [("s", "clean", a, b) for a, b in zip(y, clean)]
    rows += [("s", "adv_benign", 0, b) for b in benign] + [("s", "adv_malicious", 1, b) for b in malicious]
    pools = spark.createDataFrame(rows, "scope string, pool string, label int, score double")
    grid = thresholds.threshold_grid(pools, points=points, base=base)
    cand = thresholds.gate_candidates(
        thresholds.evaluate_grid(pools, grid, points),
        clean_fpr_max=clean_max,
        attacked_fpr_max=attacked_max,
        adv_recall_min=recall,
        margin=margin,
    )
    return thresholds.select_gated(cand).first()


def test_gate_modes(spark):
    y = [0, 0, 1, 1]
    r = gate(spark, y, [0.05, 0.2, 0.85, 0.95], [0.01, 0.02, 0.4, 0.55], [0.9, 0.92, 0.95, 0.97], 50, 0.5, 0.25, 0.25, 0.75)
    assert r["selection_mode"] == "internal_margin_gate_pass_lexicographic" and r["num_gate_pass"] > 0
    r = gate(spark, y, [0.1, 0.2, 0.8, 0.9], [0.05, 0.15, 0.25, 0.35], [0.31, 0.32, 0.33, 0.34], 60, 0.3, 0.5, 0.25, 0.75, 0.8)
    assert r["selection_mode"] == "gate_pass_lexicographic"
    assert r["num_internal_gate_pass"] == 0 and r["num_gate_pass"] > 0
    r = gate(spark, y, [0.05, 0.95, 0.9, 0.92], [0.3, 0.35, 0.4, 0.45], [0.18, 0.22, 0.25, 0.27], 80, 0.8, 0.005, 0.005, 0.99)
    assert r["selection_mode"] == "no_pass_adv_priority" and r["num_gate_pass"] == 0
    assert r["adv_shortfall"] <= 0.8 and r["selected_threshold"] < 0.8


def test_train_floor_takes_from_the_largest_capture(spark):
    caps = ["dom.csv"] * 18 + ["other.csv"] * 4 + ["mal.csv"] * 6
    rows = [(c, i, "bluetooth", int(c == "mal.csv"), i < 16) for i, c in enumerate(caps)]
    df = spark.createDataFrame(rows, "cap string, row bigint, p string, label int, is_val boolean")
    stratum = (F.col("p") == "bluetooth") & (F.col("label") == 0)
    outs = [
        {r["row"]: r["is_val"] for r in split.train_floor(
            df.repartition(n), stratum=stratum, capture="cap", row="row", floor=10, seed=42).collect()}
        for n in (1, 4)
    ]
    assert outs[0] == outs[1] and len(outs[0]) == 28
    moved = [i for i in range(16) if not outs[0][i]]
    assert {caps[i] for i in moved} == {"dom.csv"}
    assert sum(not outs[0][i] for i in range(22)) == 10


def test_capture_split_modes(spark):
    rows = [(f"c{i % 40}", i, "wifi", 0) for i in range(400)]
    rows += [("one", i, "mqtt", 1) for i in range(25)] + [("solo", 0, "bluetooth", 1)]
    df = spark.createDataFrame(rows, "cap string, row bigint, p string, label int")
    marked, events = split.capture_val_split(df, strata=["p", "label"], capture="cap", row="row", seed=42, mod=5)
    out = marked.collect()
    assert len(out) == len(rows)
    sides = {}
    for r in out:
        if r["p"] == "wifi":
            sides.setdefault(r["cap"], set()).add(r["is_val"])
    assert all(len(s) == 1 for s in sides.values()) and {True, False} == set().union(*sides.values())
    assert sum(r["is_val"] for r in out if r["p"] == "mqtt") == 5
    assert not any(r["is_val"] for r in out if r["p"] == "bluetooth")
    assert [(e["p"], e["fallback_type"]) for e in events.collect()] == [("mqtt", "row_level_single_file")]
    with pytest.raises(RuntimeError):
        split.capture_val_split(
            df, strata=["p", "label"], capture="cap", row="row", seed=42, allow_row_fallback=False
        )


def test_adaptive_targets(spark):
    rows = [(40, 0.10, 6, 9), (40, 0.05, 3, 4), (20, 0.30, 8, 10), (10, 0.10, 20, 50), (5, 0.10, 10, 100), (0, 0.5, 1, 1)]
    df = spark.createDataFrame(rows, "n bigint, f double, lo int, hi int")
    t = sample.adaptive_target(F.col("n"), F.col("f"), F.col("lo"), F.col("hi"))
    assert sorted(r[0] for r in df.select(t).collect()) == sorted([6, 3, 8, 10, 5, 0])


def test_cap_fraction(spark):
    df = spark.createDataFrame([("bluetooth", i) for i in range(100)], "p string, i bigint")
    picks = [
        {r["i"] for r in sample.cap_fraction(
            df.repartition(n), by="p", group="bluetooth", pool_rows=120, fraction=0.5, key=["i"], seed=1).collect()}
        for n in (1, 5)
    ]
    assert len(picks[0]) == 60 and picks[0] == picks[1]


def test_capture_stats_and_feasibility(spark):
    rows = [("bt_a", "bluetooth", 0, True), ("bt_a", "bluetooth", 0, False), ("bt_b", "bluetooth", 1, True), ("w", "wifi", 0, True)]
    df = spark.createDataFrame(rows, "cap string, p string, label int, v boolean")
    out = {(r["p"], r["label"]): r for r in profile.capture_stats(df, strata=["p", "label"], capture="cap", is_val="v").collect()}
    first = out[("bluetooth", 0)]
    assert (first["rows"], first["unique_files"], first["largest_file_share"], first["val_rows"]) == (2, 1, 1.0, 1)
    vals = spark.createDataFrame([(199,), (200,)], "val_rows bigint")
    ok = {r["val_rows"]: r["strict_fpr_feasible"] for r in profile.fpr_feasibility(vals, max_fpr=0.005).collect()}
    assert ok == {199: False, 200: True}


def test_decision_order(spark):
    rows = [
        ("wifi", "xgboost", "A", True, 0.001, 0.001, 0.995, 0.91, 0.88), ("mqtt", "xgboost", "A", True, 0.002, 0.001, 0.994, 0.90, 0.87),
        ("wifi", "catboost", "B", True, 0.003, 0.002, 0.993, 0.89, 0.86), ("mqtt", "catboost", "B", True, 0.003, 0.002, 0.993, 0.89, 0.86),
        ("wifi", "mlp", "C", False, 0.010, 0.004, 0.990, 0.85, 0.80), ("mqtt", "mlp", "C", False, 0.011, 0.004, 0.990, 0.84, 0.79),
    ]
    df = spark.createDataFrame(
        [(*r[:3], 42, r[3], "none" if r[3] else "fpr_only", *r[4:]) for r in rows],
        "protocol string, model_name string, family_id string, seed int, gate_pass boolean, gate_failure_category string,"
        " attacked_benign_fpr double, clean_fpr double, adv_malicious_recall double, clean_f1 double, robust_f1 double",
    )
    ranked = decide.rank_global(decide.global_candidates(df, protocols=["wifi", "mqtt"]))
    order = [r["candidate_group_key"] for r in ranked.orderBy("final_rank").collect()]
    assert order == ["xgboost__A", "catboost__B", "mlp__C"]
    short = decide.shortlist(ranked, k=1, models=["xgboost", "catboost"]).collect()
    assert {r["model_name"] for r in short} == {"xgboost", "catboost"}


def test_published_counts(spark):
    df = spark.createDataFrame(
        [("wifi", 1510066, 41725, 12, 2794), ("mqtt", 100, 0, 0, 1)], "scope string, tp bigint, tn bigint, fp bigint, fn bigint"
    )
    out = {r["scope"]: r for r in metrics.confusion_ratios(df).collect()}
    assert np.isclose(out["wifi"]["precision"], 0.9999920533906196, rtol=1e-12)
    assert np.isclose(out["wifi"]["recall"], 0.9981531668495432, rtol=1e-12)
    assert np.isclose(out["wifi"]["f1"], 0.9990717639594328, rtol=1e-12)
    assert np.isclose(out["wifi"]["fpr"], 0.00028751467522821476, rtol=1e-12)
    assert out["mqtt"]["fpr"] is None


def test_rowwise_average_precision_with_large_ties(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 3000), np.round(rng.random(3000), 1)
    df = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(y, s)], "g string, label int, score double")
    got = rank_metrics.average_precision_rowwise(df, by="g", score="score", label="label").first()[1]
    tp, total = 0, 0.0
    for n, (_, lab) in enumerate(sorted(zip(s, y), reverse=True), 1):
        if lab:
            tp += 1
            total += tp / n
    assert np.isclose(got, total / y.sum(), rtol=1e-12)


def test_md5_buckets(spark):
    df = spark.createDataFrame([("x", 38), ("y", 69), ("Bluetooth/a/b.csv", 99)], "t string, b int")
    assert all(r[0] == r[1] for r in df.select(md5_bucket("t", 100), "b").collect())


def test_schema_guard_and_violations(spark):
    assert feature_columns([*METADATA_COLUMNS, "Rate", "Tot sum"]) == ["Rate", "Tot sum"]
    for bad in ([*METADATA_COLUMNS], [*METADATA_COLUMNS, "a", "a"], ["label", *METADATA_COLUMNS]):
        with pytest.raises(ValueError):
            feature_columns(bad)


def test_integrity_names_each_kind(spark):
    index = {"min": 0, "avg": 1, "max": 2}
    kinds = ("p string, x0 array<double>, x array<double>, q int, p_lower array<double>, p_upper array<double>, "
             "p_span array<double>, p_cap array<double>, p_locked array<boolean>")  # fmt: skip
    x0 = [1.0, 2.0, 3.0]
    cases = {
        "fine": ([1.0, 2.5, 3.0], 3),
        "below_lower_violations": ([-1.0, 2.0, 3.0], 3),
        "above_upper_violations": ([1.0, 11.0, 11.5], 3),
        "locked_change_rows": ([1.0, 2.0, 4.0], 3),
        "relation_violation_rows": ([2.5, 2.0, 3.0], 3),
        "max_queries": ([1.0, 2.5, 3.0], 9),
    }
    for kind, (x, queries) in cases.items():
        profile = [[0.0] * 3, [10.0] * 3, [10.0] * 3, [9.0] * 3, [False, False, True]]
        rows = [("a", x0, x, queries, *profile), ("a", x0, x0, 1, *profile)]
        df = spark.createDataFrame(rows, kinds)
        found = constraints.integrity(df, x="x", x0="x0", index=index, n=3, eps=0.5, by=["p"], queries="q")
        assert found.first()["rows"] == 2 and found.first()["changed_rows"] == 1
        if kind == "fine":
            constraints.assert_integrity(found, budget=5)
        else:
            with pytest.raises(AssertionError, match=kind):
                constraints.assert_integrity(found, budget=5)


def test_predictions_are_attached_once(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    out = combine.attach_predictions(df, spark.createDataFrame([(1, 0.5), (None, 0.1)], "id int, s double"), key=["id"])
    assert {r.id: r.s for r in out.collect()} == {1: 0.5, 2: None, None: 0.1}
    with pytest.raises(ValueError):
        combine.attach_predictions(df, spark.createDataFrame([(1, 0.5), (1, 0.6)], "id int, s double"), key=["id"])


def test_search_repairs_and_scores_its_best_candidates(spark):
    index = {"min": 0, "avg": 1, "max": 2}
    x0 = [1.0, 2.0, 3.0, 5.0]
    rows = [(i, x0, [0.0] * 4, [10.0] * 4, [10.0] * 4, [9.0] * 4, [False, False, False, True]) for i in range(30)]
    df = spark.createDataFrame(
        rows,
        "id int, x array<double>, p_lower array<double>, p_upper array<double>, p_span array<double>, p_cap array<double>, "
        "p_locked array<boolean>",
    )
    plan = search.SearchPlan(eps=0.2, budget=20, steps=4, candidates=4, subset=1, refine=2, objective="maximize")
    # a higher average helps, and most moves of it cross the maximum, which the repair mends
    margin = lambda v: F.get(v, F.lit(1)) - F.lit(2.9)
    out, info = search.hill_climb(df, key="id", x="x", n=4, margin=margin, plan=plan, index=index)
    again, _ = search.hill_climb(df, key="id", x="x", n=4, margin=margin, plan=plan, index=index)
    rows = sorted(out.collect())
    assert info["steps"] >= 1 and rows == sorted(again.collect())
    for r in rows:
        low, mean, high, locked = r.x_cur
        assert low - 1e-6 <= mean <= high + 1e-6 and locked == 5.0 and r.queries <= 20
        assert all(abs(a - b) <= 2.0 + 1e-6 for a, b in zip(r.x_cur, x0))
        assert r.margin >= r.baseline_margin and r.success == (r.margin >= 0)
    assert any(r.success for r in rows) and any(r.moves for r in rows)


def test_search_steps_the_nearest_rows_and_keeps_the_others(spark):
    rows = [(i, [float(i), 1.0], [0.0] * 2, [10.0] * 2, [10.0] * 2, [9.0] * 2, [False, True]) for i in range(9)]
    df = spark.createDataFrame(
        rows,
        "id int, x array<double>, p_lower array<double>, p_upper array<double>, p_span array<double>, p_cap array<double>, "
        "p_locked array<boolean>",
    )
    plan = search.SearchPlan(eps=0.1, budget=6, steps=2, candidates=4, subset=1, refine=2, objective="maximize", active_cap=3)
    margin = lambda v: F.get(v, F.lit(0)) - F.lit(5.5)
    out, info = search.hill_climb(df, key="id", x="x", n=2, margin=margin, plan=plan)
    got = {r.id: r for r in out.collect()}
    assert sorted(got) == list(range(9)) and info["active_max"] == 3 and info["active_total"] == 6
    # those furthest from success first; done rows and rows that waited are as they were
    assert [i for i, r in got.items() if r.queries == 0] and all(got[i].queries == 0 for i in (6, 7, 8))
    assert sum(r.queries > 0 for r in got.values()) == 6 and all(got[i].x_cur[0] == i for i in got if got[i].queries == 0)
