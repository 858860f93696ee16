"""Confusion counts, ratios, score summaries and attack rates per slice.

Every measure starts from one hash aggregation over the slice columns; counts are mergeable, so the global row is a
second aggregation over the handful of slice rows instead of an expanded scan of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.numeric import f_beta, ratio
from flowlens.operators.rank_metrics import rank_metrics
from flowlens.plans.ordered import exact_quantiles
from flowlens.plans.quantiles import wide_quantiles
from flowlens.plans.small import null_safe_join

GLOBAL_SCOPE = "global_protocol_routed"
COUNTS = ["tp", "tn", "fp", "fn"]


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def confusion_counts(df: DataFrame, *, label: str, pred: str, by: list[str]) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        _count_if((y == 1) & (p == 1)).alias("tp"),
        _count_if((y == 0) & (p == 0)).alias("tn"),
        _count_if((y == 0) & (p == 1)).alias("fp"),
        _count_if((y == 1) & (p == 0)).alias("fn"),
    )


def with_totals(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "n": F.expr("tp + tn + fp + fn"),
            "n_benign": F.expr("tn + fp"),
            "n_attack": F.expr("tp + fn"),
        }
    )


def scope_rollup(counts: DataFrame, scope: str, sums: list[str], global_name: str = GLOBAL_SCOPE) -> DataFrame:
    """The per-scope rows plus one global row, from mergeable sums."""
    return counts.withColumnRenamed(scope, "__s").groupingSets([["__s"], []], "__s").agg(
        F.when(F.grouping("__s") == 1, F.lit(global_name)).otherwise(F.col("__s")).alias("scope"),
        *[F.sum(c).alias(c) for c in sums],
    ).select("scope", *sums)


def confusion_ratios(counts: DataFrame, policy: str = "null") -> DataFrame:
    """Add precision, recall, f1 and fpr under the given empty-denominator policy."""
    precision = ratio("tp", F.expr("tp + fp"), policy)
    recall = ratio("tp", F.expr("tp + fn"), policy)
    if policy == "max1":
        f1 = F.lit(2.0) * precision * recall / F.greatest(F.lit(1e-12), precision + recall)
    else:
        f1 = ratio(F.expr("2 * tp"), F.expr("2 * tp + fp + fn"), policy)
    return counts.withColumns(
        {"precision": precision, "recall": recall, "f1": f1, "fpr": ratio("fp", F.expr("fp + tn"), policy)}
    )


def merge_counts(counts: DataFrame, *, by: list[str]) -> DataFrame:
    """Confusion counts of parts added up."""
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])


def slice_metrics(
    df: DataFrame, *, label: str, pred: str, score: str, by: str, policy: str = "zero", with_global: bool = False
) -> DataFrame:
    """Counts, ratios and rank metrics per slice value, with single-class slices flagged."""
    counts = confusion_counts(df, label=label, pred=pred, by=[by])
    counts = scope_rollup(counts, by, COUNTS) if with_global else counts.withColumnRenamed(by, "scope")
    ranks = rank_metrics(df, by=by, score=score, label=label, with_global=GLOBAL_SCOPE if with_global else None)
    out = confusion_ratios(with_totals(counts), policy)
    return null_safe_join(slice_flags(out), ranks, ["scope"], "left")


def slice_flags(counts: DataFrame) -> DataFrame:
    single = ((F.col("n_benign") == 0) | (F.col("n_attack") == 0)).cast("int")
    return counts.withColumns(
        {
            "single_class_slice": single,
            "slice_warning": F.when(single == 1, F.lit("single_class_slice")).otherwise(F.lit("")),
        }
    )


def log_loss(label: str, score: str, eps: float = 1e-15) -> Column:
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1.0 - eps))
    y = F.col(label).cast("double")
    return -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))


def brier(label: str, score: str) -> Column:
    d = F.col(score) - F.col(label)
    return d * d


def extended_metrics(df: DataFrame, *, label: str, pred: str, score: str, by: str) -> DataFrame:
    """The full per-scope report: 43 measures of a thresholded score, one row per scope and one global row.

    Means, deviations and losses are carried as sums so the global row comes from the slice rows; quantiles and rank
    metrics are computed per scope and globally from value counts.
    """
    y, s = F.col(label), F.col(score)
    base = df.groupBy(by).agg(
        _count_if((y == 1) & (F.col(pred) == 1)).alias("tp"),
        _count_if((y == 0) & (F.col(pred) == 0)).alias("tn"),
        _count_if((y == 0) & (F.col(pred) == 1)).alias("fp"),
        _count_if((y == 1) & (F.col(pred) == 0)).alias("fn"),
        F.avg(s).alias("m"),
        F.var_pop(s).alias("v"),
        F.min(s).alias("lo"),
        F.max(s).alias("hi"),
        F.coalesce(F.sum(F.when(y == 1, s)), F.lit(0.0)).alias("sum_attack"),
        F.coalesce(F.sum(F.when(y == 0, s)), F.lit(0.0)).alias("sum_benign"),
        F.sum(log_loss(label, score)).alias("sum_ll"),
        F.sum(brier(label, score)).alias("sum_brier"),
    )
    base = base.withColumn("n", F.expr("tp + tn + fp + fn"))
    merged = base.groupingSets([[by], []], by).agg(
        F.when(F.grouping(by) == 1, F.lit(GLOBAL_SCOPE)).otherwise(F.col(by)).alias("scope"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.sum("n").alias("n_rows"),
        (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("score_mean"),
        (F.sum((F.col("v") + F.col("m") * F.col("m")) * F.col("n")) / F.sum("n")).alias("sq_mean"),
        F.min("lo").alias("score_min"),
        F.max("hi").alias("score_max"),
        *[F.sum(c).alias(c) for c in ("sum_attack", "sum_benign", "sum_ll", "sum_brier")],
    ).drop(by)
    c = merged.withColumns(
        {
            "support_attack": F.expr("tp + fn"),
            "support_benign": F.expr("tn + fp"),
            "predicted_attack": F.expr("tp + fp"),
            "predicted_benign": F.expr("tn + fn"),
            "accuracy": ratio(F.expr("tp + tn"), "n_rows"),
            "precision": ratio("tp", F.expr("tp + fp")),
            "recall": ratio("tp", F.expr("tp + fn")),
            "specificity": ratio("tn", F.expr("tn + fp")),
            "f1": ratio(F.expr("2 * tp"), F.expr("2 * tp + fp + fn")),
            "jaccard": ratio("tp", F.expr("tp + fp + fn")),
            "fpr": ratio("fp", F.expr("fp + tn")),
            "fnr": ratio("fn", F.expr("fn + tp")),
            "npv": ratio("tn", F.expr("tn + fn")),
            "fdr": ratio("fp", F.expr("fp + tp")),
            "false_omission_rate": ratio("fn", F.expr("fn + tn")),
        }
    )
    n = F.col("n_rows")
    c = c.withColumns(
        {
            "tpr": F.col("recall"),
            "tnr": F.col("specificity"),
            "prevalence": ratio("support_attack", n),
            "predicted_positive_rate": ratio("predicted_attack", n),
            "predicted_negative_rate": ratio("predicted_benign", n),
            "balanced_accuracy": (F.col("recall") + F.col("specificity")) / F.lit(2.0),
            "f0_5": f_beta(F.col("precision"), F.col("recall"), 0.5),
            "f2": f_beta(F.col("precision"), F.col("recall"), 2.0),
            "gmean": F.sqrt(F.col("recall") * F.col("specificity")),
            "youden_j": F.col("recall") + F.col("specificity") - F.lit(1.0),
            "markedness": F.col("precision") + F.col("npv") - F.lit(1.0),
            "lr_positive": ratio("recall", "fpr"),
            "lr_negative": ratio("fnr", "specificity"),
            "log_loss": F.col("sum_ll") / n,
            "brier_score": F.col("sum_brier") / n,
            "attack_score_mean": ratio("sum_attack", "support_attack"),
            "benign_score_mean": ratio("sum_benign", "support_benign"),
            "score_std": F.sqrt(
                F.greatest(F.col("sq_mean") - F.col("score_mean") * F.col("score_mean"), F.lit(0.0))
            ),
        }
    )
    d = {k: F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn")}
    mcc_den = F.sqrt((d["tp"] + d["fp"]) * (d["tp"] + d["fn"]) * (d["tn"] + d["fp"]) * (d["tn"] + d["fn"]))
    chance = ratio("support_attack", n) * ratio("predicted_attack", n) + ratio("support_benign", n) * ratio(
        "predicted_benign", n
    )
    c = c.withColumns(
        {
            "mcc": ratio(d["tp"] * d["tn"] - d["fp"] * d["fn"], mcc_den),
            "cohen_kappa": ratio(F.col("accuracy") - chance, F.lit(1.0) - chance),
            "diagnostic_odds_ratio": ratio("lr_positive", "lr_negative"),
        }
    ).drop("sum_attack", "sum_benign", "sum_ll", "sum_brier", "sq_mean")
    probs = {"score_p01": 0.01, "score_p05": 0.05, "score_p50": 0.5, "score_p95": 0.95, "score_p99": 0.99}
    per_scope = wide_quantiles(df, [by], {score: s}, probs).withColumnRenamed(by, "scope")
    overall = wide_quantiles(df, [], {score: s}, probs).withColumn("scope", F.lit(GLOBAL_SCOPE))
    per_scope, overall = (q.select("scope", *probs) for q in (per_scope, overall))
    ranks = rank_metrics(df, by=by, score=score, label=label, with_global=GLOBAL_SCOPE)
    out = null_safe_join(c, per_scope.unionByName(overall), ["scope"], "left")
    return null_safe_join(out, ranks, ["scope"], "left")


def attack_success(df: DataFrame, *, label: str, baseline: str, attacked: str, by: list[str]) -> DataFrame:
    """Share of attacks an adversary turns benign: over all attacks, and over those caught before."""
    attack = F.col(label) == 1
    caught = attack & (F.col(baseline) == 1)
    missed = F.col(attacked) == 0
    counts = df.groupBy(*by).agg(
        _count_if(attack & missed).alias("asr_all_num"),
        _count_if(attack).alias("asr_all_den"),
        _count_if(caught & missed).alias("asr_conditional_num"),
        _count_if(caught).alias("asr_conditional_den"),
    )
    return counts.withColumns(
        {
            "asr_all": ratio("asr_all_num", "asr_all_den"),
            "asr_conditional": ratio("asr_conditional_num", "asr_conditional_den"),
        }
    )


def false_positive_attack(df: DataFrame, *, label: str, baseline: str, attacked: str, by: list[str]) -> DataFrame:
    """Benign-side mirror of ``attack_success``."""
    benign = F.col(label) == 0
    clean = benign & (F.col(baseline) == 0)
    flagged = F.col(attacked) == 1
    counts = df.groupBy(*by).agg(
        _count_if(benign & flagged).alias("fp_attack_rate_num"),
        _count_if(benign).alias("fp_attack_rate_den"),
        _count_if(clean & flagged).alias("fp_attack_rate_conditional_num"),
        _count_if(clean).alias("fp_attack_rate_conditional_den"),
    )
    return counts.withColumns(
        {
            "fp_attack_rate": ratio("fp_attack_rate_num", "fp_attack_rate_den"),
            "fp_attack_rate_conditional": ratio("fp_attack_rate_conditional_num", "fp_attack_rate_conditional_den"),
        }
    )


def summary_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, median and 95th percentile."""
    mean = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return null_safe_join(mean, exact_quantiles(df, by, value, {"median": 0.5, "p95": 0.95}), by)


def worst_case(df: DataFrame, *, by: list[str], key: str, fpr: str, recall: str, f1: str) -> DataFrame:
    """Worst attacked FPR, recall and F1 over scenarios with the scenario that caused each; NULLs are ignored.

    Ties go to the alphabetically first scenario.
    """

    def worst(col: str, largest: bool) -> Column:
        signed = -F.col(col) if largest else F.col(col)
        return F.min(F.when(F.col(col).isNotNull(), F.struct(signed.alias("v"), F.col(key).alias("k"))))

    agg = df.groupBy(*by).agg(worst(fpr, True).alias("a"), worst(recall, False).alias("b"), worst(f1, False).alias("c"))
    return agg.select(
        *by,
        (-F.col("a.v")).alias("worst_attacked_benign_fpr"),
        F.col("a.k").alias("worst_attacked_benign_fpr_key"),
        F.col("b.v").alias("worst_adv_malicious_recall"),
        F.col("b.k").alias("worst_adv_recall_key"),
        F.col("c.v").alias("worst_robust_f1"),
        F.col("c.k").alias("worst_robust_f1_key"),
    )


def coverage(df: DataFrame, routed: str, by: list[str]) -> DataFrame:
    """Share of rows that have a routed prediction."""
    agg = df.groupBy(*by).agg(F.count(routed).alias("covered_rows"), F.count("*").alias("rows"))
    return agg.withColumn("coverage", ratio("covered_rows", "rows"))
