"""ROC and precision-recall measures over tie-grouped scores.

Scores first collapse to ``(scope, score) -> positives, negatives`` with map-side combining, so ties cost one row
however many there are, and the curves are running totals over ranges of the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.numeric import harmonic_gap, ratio
from flowlens.plans.ordered import running_totals


def score_histogram(
    df: DataFrame, *, by: str, score: str, label: str, with_global: str | None = None
) -> DataFrame:
    """``(scope, score, pos, neg)``; ``with_global`` names an extra scope holding all rows."""
    hist = df.groupBy(F.col(by).alias("scope"), F.col(score).alias("score")).agg(
        F.count(F.when(F.col(label) == 1, F.lit(1))).alias("pos"),
        F.count(F.when(F.col(label) == 0, F.lit(1))).alias("neg"),
    )
    if with_global is None:
        return hist
    everything = (
        hist.groupBy("score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .select(F.lit(with_global).alias("scope"), "score", "pos", "neg")
    )
    return hist.unionByName(everything)


def roc_points(
    df: DataFrame, *, by: str, score: str, label: str, with_global: str | None = None
) -> DataFrame:
    """One row per distinct score, from high to low: cumulative tp and fp with their rates."""
    hist = score_histogram(df, by=by, score=score, label=label, with_global=with_global)
    cum = running_totals(hist, ["scope"], [-F.col("score")], {"pos": "pos", "neg": "neg"})
    return cum.select(
        "scope",
        "score",
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.col("total_pos").alias("n_pos"),
        F.col("total_neg").alias("n_neg"),
        ratio("cum_pos", "total_pos").alias("tpr"),
        ratio("cum_neg", "total_neg").alias("fpr"),
    )


def _precision(tp: Column, fp: Column) -> Column:
    return tp.cast("double") / F.greatest(tp + fp, F.lit(1)).cast("double")


def rank_metrics_from_points(points: DataFrame) -> DataFrame:
    """``roc_auc``, ``pr_auc_step`` and ``pr_auc_trapz`` per scope; NULL AUC when a class is missing."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    d_fpr, d_tpr = ratio("neg", "n_neg"), ratio("pos", "n_pos")
    mid_tpr = ratio(F.lit(0.5) * (tp + tp - pos), "n_pos")
    here = _precision(tp, fp)
    before = F.when(tp + fp - pos - neg == 0, F.lit(1.0)).otherwise(_precision(tp - pos, fp - neg))
    out = points.groupBy("scope").agg(
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        F.sum(d_fpr * mid_tpr).alias("roc_auc"),
        F.coalesce(F.sum(d_tpr * here), F.lit(0.0)).alias("pr_auc_step"),
        F.coalesce(F.sum(d_tpr * (here + before) / F.lit(2.0)), F.lit(0.0)).alias("pr_auc_trapz"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select("scope", F.when(both, F.col("roc_auc")).alias("roc_auc"), "pr_auc_step", "pr_auc_trapz")


def rank_metrics(df: DataFrame, *, by: str, score: str, label: str, with_global: str | None = None) -> DataFrame:
    return rank_metrics_from_points(roc_points(df, by=by, score=score, label=label, with_global=with_global))


def roc_auc_rank(df: DataFrame, *, by: str, score: str, label: str, empty: float = 0.0) -> DataFrame:
    """ROC-AUC from average ranks of tied scores; ``empty`` when one class is missing."""
    hist = score_histogram(df, by=by, score=score, label=label)
    ranked = running_totals(hist.withColumn("n", F.expr("pos + neg")), ["scope"], ["score"], {"n": "n"})
    avg_rank = F.col("cum_n") - (F.col("n") - F.lit(1)) / F.lit(2.0)
    agg = ranked.groupBy("scope").agg(
        F.sum(avg_rank * F.col("pos")).alias("rank_sum"), F.sum("pos").alias("p"), F.sum("neg").alias("q")
    )
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    auc = (F.col("rank_sum") - p * (p + 1) / F.lit(2.0)) / (p * q)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), auc))
    return agg.select("scope", F.when((p > 0) & (q > 0), clipped).otherwise(F.lit(empty)).alias("roc_auc"))


def average_precision_rowwise(df: DataFrame, *, by: str, score: str, label: str) -> DataFrame:
    """Average precision over single rows, positives first inside a tie (the optimistic flavour).

    With F negatives and T positives above a tie of p positives the tie adds sum((T+i)/(T+F+i), i=1..p), which is
    p - F * (H(T+F+p) - H(T+F)), so a tie of any size stays one row.
    """
    points = roc_points(df, by=by, score=score, label=label)
    t0, f0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    part = F.col("pos") - f0 * harmonic_gap(t0 + f0, t0 + f0 + F.col("pos"))
    agg = points.groupBy("scope").agg(F.sum(part).alias("s"), F.max("n_pos").alias("n_pos"))
    return agg.select("scope", ratio("s", "n_pos", "zero").alias("average_precision"))
