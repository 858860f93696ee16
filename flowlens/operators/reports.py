"""Report tables composed from the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.operators.metrics import COUNTS, confusion_counts, confusion_ratios, scope_rollup, worst_case
from flowlens.operators.logistic import fit_logistic as train_logistic
from flowlens.operators.constraints import attach_profile, vector
from flowlens.operators.perturb import attach_surrogate, fgsm_columns, scenario_metrics
from flowlens.operators.combine import weighted_union
from flowlens.operators.rank_metrics import rank_metrics
from flowlens.operators.replay import case_ids
from flowlens.operators.score import LinearModel, contributions, routed_score, top_contributions
from flowlens.operators.thresholds import evaluate_grid, gate_candidates, select_gated, threshold_grid
from flowlens.plans.small import cut_lineage, null_safe_join, once_per_row, pinned


def protocol_table(df: DataFrame, *, by: str, label: str, pred: str, score: str, threshold: str) -> DataFrame:
    """Operating-point table: one row per protocol and a Global row."""
    counts = scope_rollup(confusion_counts(df, label=label, pred=pred, by=[by]), by, COUNTS, "Global")
    ranks = rank_metrics(df, by=by, score=score, label=label, with_global="Global")
    thr = df.groupBy(F.col(by).alias("scope")).agg(F.max(threshold).alias("threshold"))
    out = null_safe_join(confusion_ratios(counts), ranks, ["scope"], "left")
    out = null_safe_join(out, thr, ["scope"], "left")
    return out.select(
        "scope",
        "threshold",
        "precision",
        "recall",
        "f1",
        "fpr",
        "roc_auc",
        F.col("pr_auc_step").alias("pr_auc"),
        *COUNTS,
    )


def robustness_table(counts: DataFrame, *, by: str) -> DataFrame:
    """Worst attacked recall and F1 per scope. Benign rows are never perturbed, so the attacked FPR stays NULL."""
    m = scenario_metrics(counts, by=by)
    clean = m.where(F.col("method") == "baseline").select(
        "scope", F.col("fpr").alias("clean_fpr"), F.col("recall").alias("clean_recall"), F.col("f1").alias("clean_f1")
    )
    key = F.concat_ws("@eps=", F.col("method"), F.col("epsilon").cast("string"))
    attacked = m.where(F.col("epsilon") > 0).withColumn("key", key)
    worst = worst_case(attacked, by=["scope"], key="key", fpr="fpr", recall="recall", f1="f1")
    return null_safe_join(clean, worst, ["scope"]).select(
        "scope",
        "clean_fpr",
        "clean_recall",
        "clean_f1",
        F.lit(None).cast("double").alias("attacked_benign_fpr"),
        F.col("worst_adv_malicious_recall").alias("adv_malicious_recall"),
        F.col("worst_robust_f1").alias("robust_f1"),
    )


def case_library(
    scored: DataFrame, models: dict[str, LinearModel], *, outcome: str, order: list[str], n: int, top: int
) -> DataFrame:
    """A few readable cases per protocol and outcome with their strongest contributions."""
    cases = case_ids(scored, protocol="protocol_used", outcome=outcome, order=[F.col(c) for c in order], n=n)
    return contributions(cases, models).withColumn("contributions", top_contributions("contributions", top))


def consolidated_report(ranked: DataFrame, stability: DataFrame, escalation: DataFrame, *, top: int = 10) -> DataFrame:
    """One table: the best candidates with their stability, and the escalation outcome on every row."""
    best = ranked.orderBy("final_rank").limit(top)
    j = null_safe_join(best, stability, ["candidate_group_key"], "left")
    esc = escalation.select(F.col("triggered").alias("escalated"), F.col("reason").alias("escalation_reason"))
    return (
        j.withColumn("one", F.lit(1))
        .join(esc.withColumn("one", F.lit(1)), "one")
        .drop("one")
        .withColumn("stable", F.coalesce("consistent_gate_pass", F.lit(False)))
    )


def robust_refit(
    train: DataFrame, val: DataFrame, profile: DataFrame, *, features: list[str], label: str, by: str, key: list[str],
    eps: float, gates: dict[str, float], w_attack: float = 2.0, w_benign: float = 1.0, grid_points: int = 100,
) -> DataFrame:
    """Warm fit, perturb the attacks the warm model catches and the benign rows, refit with the moved attacks and the
    benign rows that the warm model then flags, choose a gated threshold against both campaigns.

    Returns one decision row per group. Rows of a group without a profile stay where they are.
    """
    keep = [*key, by, label, *features]
    profile = pinned(profile)  # attached four times
    warm = train_logistic(train, features=features, label=label, by=by)

    def attacked(df: DataFrame, models: dict[str, LinearModel], up: bool) -> DataFrame:
        rows = attach_profile(df.select(*keep), profile, by=by).withColumn("x", vector(features))
        return fgsm_columns(attach_surrogate(rows, models, features, by=by), features, eps, up).select(*keep)

    def flagged(df: DataFrame) -> DataFrame:
        s = routed_score(df, warm, {}, protocol=by)
        # stored: a filter on the prediction itself would repeat the route and the score wherever they are named
        return once_per_row(s, {"__hit": F.col("prediction") == 1}).where("__hit").select(*keep)

    benign, attacks = F.col(label) == 0, F.col(label) == 1
    hard = attacked(flagged(train.where(attacks)), warm, up=False)
    hard_benign = flagged(attacked(train.where(benign), warm, up=True))
    augmented = weighted_union(train.select(*keep), hard_benign, hard, label=label, w_benign=w_benign, w_attack=w_attack)
    augmented = cut_lineage(augmented.select(by, label, "weight", *features))  # read many times by the fit below
    final = train_logistic(augmented, features=features, label=label, by=by, weight="weight")
    zero = {p: 0.5 for p in final}

    def scored(df: DataFrame, pool: str) -> DataFrame:
        s = routed_score(df, final, zero, protocol=by)
        return s.select(F.col(by).alias("scope"), F.lit(pool).alias("pool"), F.col(label).alias("label"),
                        F.col("score_attack").alias("score"))

    pools = (
        scored(val, "clean")
        .unionByName(scored(attacked(val.where(benign), final, up=True), "adv_benign"))
        .unionByName(scored(attacked(val.where(attacks), final, up=False), "adv_malicious"))
    )
    pools = cut_lineage(pools)
    grid = threshold_grid(pools, points=grid_points, base=0.5)
    return select_gated(gate_candidates(evaluate_grid(pools, grid, grid_points), **gates))
