"""Operating-threshold search under false-positive and recall limits.

Curve-based searches work on tie-grouped points. Grid searches bucket every score against its scope's grid once
(a binary search inside the row) and suffix-sum the bucket counts, instead of comparing every row to every candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.numeric import linspace, placeable, ratio
from flowlens.operators.rank_metrics import rank_metrics_from_points, roc_points
from flowlens.plans.ordered import array_position, best_row
from flowlens.plans.small import null_safe_join, pinned


def max_recall_at_fpr_lowest(points: DataFrame, max_fpr: float) -> DataFrame:
    """Lowest threshold reaching the best recall within the FPR budget; 1.0 when nothing fits, 0.5 for one class."""
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    ok = both & (F.col("fpr") <= F.lit(max_fpr))
    agg = points.groupBy("scope").agg(
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        F.min(F.when(ok, F.struct("score", "tpr", "fpr"))).alias("b"),
    )
    return agg.select(
        "scope",
        F.when(~both, F.lit(0.5)).otherwise(F.coalesce(F.col("b.score"), F.lit(1.0))).alias("threshold"),
        F.coalesce(F.col("b.tpr"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("b.fpr"), F.lit(0.0)).alias("fpr"),
    )


def with_start_point(points: DataFrame) -> DataFrame:
    """Add the point before every score: threshold +inf, nothing flagged."""
    start = points.groupBy("scope").agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg")).select(
        "scope",
        F.lit(float("inf")).alias("score"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit(0).cast("bigint").alias("neg"),
        F.lit(0).cast("bigint").alias("tp"),
        F.lit(0).cast("bigint").alias("fp"),
        "n_pos",
        "n_neg",
        F.lit(0.0).alias("tpr"),
        F.lit(0.0).alias("fpr"),
    )
    return points.unionByName(start)


def max_recall_at_fpr_highest(points: DataFrame, max_fpr: float) -> DataFrame:
    """Highest threshold among those with the best recall within the FPR budget; may be +inf."""
    ok = with_start_point(points).where(F.col("fpr") <= F.lit(max_fpr))
    best = best_row(ok, ["scope"], [F.col("tpr").desc(), F.col("score").desc()])
    return best.select("scope", F.col("score").alias("threshold"), F.col("tpr").alias("recall"), "fpr")


def max_f1_at_fpr(points: DataFrame, max_fpr: float) -> DataFrame:
    """Best F1 within the FPR budget (highest threshold on ties); the lowest FPR when nothing fits."""
    p = with_start_point(points).withColumns(
        {
            "precision": ratio("tp", F.expr("tp + fp"), "zero"),
            "f1": ratio(F.expr("2 * tp"), F.expr("tp + fp + n_pos"), "zero"),
            "ok": (F.col("fpr") <= F.lit(max_fpr)).cast("int"),
        }
    )
    order = [
        F.col("ok").desc(),
        F.when(F.col("ok") == 1, -F.col("f1")).otherwise(F.col("fpr")).asc(),
        F.col("score").desc(),
    ]
    return best_row(p, ["scope"], order).select(
        "scope",
        F.col("score").alias("threshold"),
        F.col("fpr").alias("val_fpr"),
        F.col("tpr").alias("val_recall"),
        F.col("precision").alias("val_precision"),
        F.col("f1").alias("val_f1"),
        F.col("ok").cast("double").alias("feasible"),
    )


def validation_objective(points: DataFrame, max_fpr: float, soft_penalty: bool = True) -> DataFrame:
    """F1 at the chosen threshold plus a share of PR-AUC, minus FPR penalties."""
    best = max_f1_at_fpr(points, max_fpr)
    pr = rank_metrics_from_points(points).select("scope", F.col("pr_auc_step").alias("val_pr_auc"))
    out = null_safe_join(best, pr, ["scope"])
    gap = F.greatest(F.lit(0.0), F.col("val_fpr") - F.lit(max_fpr))
    soft = F.lit(0.10) * F.col("val_fpr") / F.lit(max(max_fpr, 1e-8)) if soft_penalty else F.lit(0.0)
    objective = (
        F.col("val_f1")
        + F.lit(0.05) * F.col("val_pr_auc")
        - soft
        - F.lit(4.0) * gap
        - F.when(F.col("feasible") < 0.5, F.lit(0.10)).otherwise(F.lit(0.0))
    )
    return out.withColumns({"fpr_gap": gap, "soft_fpr_penalty": soft, "objective": objective})


def threshold_grid(
    pools: DataFrame, *, points: int, base: float | None, clip01: bool = True, pools_used: list[str] | None = None
) -> DataFrame:
    """One sorted candidate array per scope, from the span of the pooled scores of ``(scope, pool, label, score)``."""
    used = pools if pools_used is None else pools.where(F.col("pool").isin(pools_used))
    finite = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    span = used.groupBy("scope").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    if clip01:
        span = span.withColumns(
            {
                "lo": F.greatest(F.lit(0.0), F.coalesce("lo", F.lit(0.5 if base is None else base))),
                "hi": F.least(F.lit(1.0), F.coalesce("hi", F.lit(0.5 if base is None else base))),
            }
        ).withColumn("hi", F.greatest("lo", "hi"))
    grid = F.when(F.abs(F.col("hi") - F.col("lo")) < 1e-12, F.array("lo")).otherwise(
        linspace(F.col("lo"), F.col("hi"), points)
    )
    if base is not None:
        grid = F.concat(grid, F.array(F.lit(float(base))))
    return span.select("scope", F.array_sort(F.array_distinct(grid)).alias("grid"))


def grid_counts(pools: DataFrame, grid: DataFrame, points: int) -> DataFrame:
    """Counts at or above every candidate: ``(scope, threshold, tp, fp, n_pos, n_neg, adv_*)``.

    ``pools`` is ``(scope, pool, label, score)`` with pool ``clean``, ``adv_benign`` or ``adv_malicious``.
    """
    pos = array_position(F.col("grid"), placeable("score"), points + 1, inclusive=True)
    is_clean, is_b, is_m = (F.col("pool") == p for p in ("clean", "adv_benign", "adv_malicious"))

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, F.lit(1)))

    grid = pinned(grid)
    measures = ["c_pos", "c_neg", "a_ben", "a_mal"]
    hist = (
        null_safe_join(pools, grid, ["scope"])
        .withColumn("idx", pos)
        .groupBy("scope", "idx")
        .agg(
            count(is_clean & (F.col("label") == 1)).alias("c_pos"),
            count(is_clean & (F.col("label") == 0)).alias("c_neg"),
            count(is_b).alias("a_ben"),
            count(is_m).alias("a_mal"),
        )
    )
    cells = grid.select("scope", F.posexplode("grid").alias("i", "threshold")).select(
        "scope", (F.col("i") + 1).alias("idx"), "threshold"
    )
    below = grid.select("scope", F.lit(0).alias("idx"), F.lit(None).cast("double").alias("threshold"))
    dense = null_safe_join(cells.unionByName(below), hist, ["scope", "idx"], "left").fillna(0, measures)
    above = Window.partitionBy("scope").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("scope")
    return dense.select(
        "scope",
        "threshold",
        F.sum("c_pos").over(above).alias("tp"),
        F.sum("c_neg").over(above).alias("fp"),
        F.sum("a_ben").over(above).alias("adv_fp"),
        F.sum("a_mal").over(above).alias("adv_tp"),
        F.sum("c_pos").over(whole).alias("n_pos"),
        F.sum("c_neg").over(whole).alias("n_neg"),
        F.sum("a_ben").over(whole).alias("n_adv_benign"),
        F.sum("a_mal").over(whole).alias("n_adv_malicious"),
    ).where(F.col("threshold").isNotNull())


def evaluate_grid(pools: DataFrame, grid: DataFrame, points: int) -> DataFrame:
    """Clean and attacked measures of every candidate threshold."""
    c = grid_counts(pools, grid, points)
    return c.withColumns(
        {
            "clean_precision": ratio("tp", F.expr("tp + fp"), "zero"),
            "clean_recall": ratio("tp", "n_pos", "zero"),
            "clean_f1": ratio(F.expr("2 * tp"), F.expr("tp + fp + n_pos"), "zero"),
            "clean_fpr": ratio("fp", "n_neg", "zero"),
            "attacked_benign_fpr": ratio("adv_fp", "n_adv_benign"),
            "attacked_malicious_recall": ratio("adv_tp", "n_adv_malicious"),
        }
    )


def select_feasible(
    candidates: DataFrame, *, recall_target: float, adv_recall_target: float, adv_weight: float
) -> DataFrame:
    """Fewest attacked false positives among candidates meeting both recall targets, else the best penalised F1."""
    attacked = F.coalesce("attacked_benign_fpr", F.lit(0.0))
    short = F.greatest(F.lit(0.0), F.lit(recall_target) - F.col("clean_recall"))
    if adv_recall_target > 0.0:
        adv_short = F.coalesce(
            F.greatest(F.lit(0.0), F.lit(adv_recall_target) - F.col("attacked_malicious_recall")), F.lit(0.0)
        )
        adv_ok = F.coalesce(F.col("attacked_malicious_recall") >= F.lit(adv_recall_target), F.lit(True))
    else:
        adv_short, adv_ok = F.lit(0.0), F.lit(True)
    rows = candidates.withColumns(
        {"attacked_benign_fpr": attacked, "recall_shortfall": short, "adv_malicious_recall_shortfall": adv_short}
    )
    rows = rows.withColumns(
        {
            "ok": ((F.col("clean_recall") >= F.lit(recall_target)) & adv_ok).cast("int"),
            "fallback_objective": F.col("clean_f1")
            - F.lit(3.0) * F.col("attacked_benign_fpr")
            - F.lit(2.0) * F.col("recall_shortfall")
            - F.lit(adv_weight) * F.col("adv_malicious_recall_shortfall"),
        }
    )
    whole = Window.partitionBy("scope")
    rows = rows.withColumns({"num_candidates": F.count("*").over(whole), "num_feasible": F.sum("ok").over(whole)})
    # Feasible: attacked FPR, shortfall, -F1, highest threshold. Fallback: objective, attacked FPR, lowest threshold.
    feasible = F.col("ok") == 1
    order = [
        F.col("ok").desc(),
        F.when(feasible, F.col("attacked_benign_fpr")).otherwise(-F.col("fallback_objective")).asc(),
        F.when(feasible, F.col("adv_malicious_recall_shortfall")).otherwise(F.col("attacked_benign_fpr")).asc(),
        F.when(feasible, -F.col("clean_f1")).otherwise(F.col("threshold")).asc(),
        F.col("threshold").desc(),
    ]
    return best_row(rows, ["scope"], order).select(
        "scope",
        F.col("threshold").alias("selected_threshold"),
        F.when(F.col("ok") == 1, F.lit("feasible")).otherwise(F.lit("fallback")).alias("selection_mode"),
        "clean_f1",
        "clean_recall",
        "attacked_benign_fpr",
        "attacked_malicious_recall",
        "num_candidates",
        "num_feasible",
    )


def gate_category(clean_ok: Column, attacked_ok: Column, adv_ok: Column) -> Column:
    fpr_fail = ~clean_ok | ~attacked_ok
    return (
        F.when(fpr_fail & ~adv_ok, F.lit("both"))
        .when(fpr_fail, F.lit("fpr_only"))
        .when(~adv_ok, F.lit("adv_recall_only"))
        .otherwise(F.lit("none"))
    )


def data_cap_override(df: DataFrame, feasible: str = "strict_fpr_feasible") -> DataFrame:
    """Too few validation benign rows to measure the FPR: the gate fails whatever the metrics say."""
    ok = F.col(feasible)
    return df.withColumns(
        {
            "gate_pass": F.col("gate_pass") & ok,
            "gate_failure_category": F.when(ok, F.col("gate_failure_category")).otherwise(
                F.lit("data_cap_infeasible")
            ),
        }
    )


def gate_candidates(
    candidates: DataFrame, *, clean_fpr_max: float, attacked_fpr_max: float, adv_recall_min: float, margin: float = 1.0
) -> DataFrame:
    """Gate flags of every candidate threshold."""
    inner = attacked_fpr_max * max(0.0, min(1.0, margin))
    clean_ok = F.col("clean_fpr") <= F.lit(clean_fpr_max)
    attacked_ok = F.coalesce(F.col("attacked_benign_fpr") <= F.lit(attacked_fpr_max), F.lit(False))
    inner_ok = F.coalesce(F.col("attacked_benign_fpr") <= F.lit(inner), F.lit(False))
    adv_ok = F.coalesce(F.col("attacked_malicious_recall") >= F.lit(adv_recall_min), F.lit(False))
    return candidates.withColumns(
        {
            "adv_shortfall": F.greatest(F.lit(0.0), F.lit(adv_recall_min) - F.col("attacked_malicious_recall")),
            "gate_pass_internal": clean_ok & inner_ok & adv_ok,
            "gate_pass": clean_ok & attacked_ok & adv_ok,
            "gate_failure_category": gate_category(clean_ok, attacked_ok, adv_ok),
        }
    )


def select_gated(gated: DataFrame) -> DataFrame:
    """Three-mode choice: inside the safety margin, else inside the gates, else the smallest recall shortfall.

    Later keys are attacked FPR, clean FPR, adversarial recall, F1, then the higher threshold; NULLs rank last.
    """
    whole = Window.partitionBy("scope")
    rows = gated.withColumns(
        {
            "num_candidates": F.count("*").over(whole),
            "num_internal_gate_pass": F.sum(F.col("gate_pass_internal").cast("int")).over(whole),
            "num_gate_pass": F.sum(F.col("gate_pass").cast("int")).over(whole),
        }
    )
    rows = rows.withColumn(
        "selection_mode",
        F.when(F.col("num_internal_gate_pass") > 0, F.lit("internal_margin_gate_pass_lexicographic"))
        .when(F.col("num_gate_pass") > 0, F.lit("gate_pass_lexicographic"))
        .otherwise(F.lit("no_pass_adv_priority")),
    )
    mode = F.col("selection_mode")
    first = (
        F.when(mode == "internal_margin_gate_pass_lexicographic", (~F.col("gate_pass_internal")).cast("double"))
        .when(mode == "gate_pass_lexicographic", (~F.col("gate_pass")).cast("double"))
        .otherwise(F.col("adv_shortfall"))
    )
    adv = F.when(mode != "no_pass_adv_priority", F.col("attacked_malicious_recall"))
    order = [
        first.asc_nulls_last(),
        F.col("attacked_benign_fpr").asc_nulls_last(),
        F.col("clean_fpr").asc_nulls_last(),
        adv.desc_nulls_last(),
        F.col("clean_f1").desc_nulls_last(),
        F.col("threshold").desc(),
    ]
    return best_row(rows, ["scope"], order).select(
        "scope",
        F.col("threshold").alias("selected_threshold"),
        "selection_mode",
        "gate_pass",
        "gate_failure_category",
        "adv_shortfall",
        "clean_f1",
        "clean_fpr",
        "clean_recall",
        "attacked_benign_fpr",
        "attacked_malicious_recall",
        "num_candidates",
        "num_internal_gate_pass",
        "num_gate_pass",
    )


def select_base(pools: DataFrame, *, max_fpr: float, points: int = 300) -> DataFrame:
    """Best F1 minus four times the excess FPR on an even grid; the lowest threshold wins ties."""
    clean = pools.where(F.col("pool") == "clean")
    grid = threshold_grid(clean, points=points, base=None, clip01=False)
    rows = evaluate_grid(clean, grid, points)
    penalty = F.lit(4.0) * F.greatest(F.lit(0.0), F.col("clean_fpr") - F.lit(max_fpr))
    rows = rows.withColumn("objective", F.col("clean_f1") - penalty)
    best = best_row(rows, ["scope"], [F.col("objective").desc(), F.col("threshold").asc()])
    return best.select("scope", F.col("threshold").alias("base_threshold"), "objective", "clean_f1", "clean_fpr")


def threshold_sweep(df: DataFrame, *, by: str, score: str, label: str, max_fpr: float) -> DataFrame:
    """Both maximum-recall flavours and the F1 choice side by side, from one set of curve points."""
    points = roc_points(df, by=by, score=score, label=label)
    low = max_recall_at_fpr_lowest(points, max_fpr).select("scope", F.col("threshold").alias("lowest_threshold"))
    high = max_recall_at_fpr_highest(points, max_fpr).select("scope", F.col("threshold").alias("highest_threshold"))
    f1 = max_f1_at_fpr(points, max_fpr).select("scope", F.col("threshold").alias("f1_threshold"))
    return null_safe_join(null_safe_join(low, high, ["scope"]), f1, ["scope"])
