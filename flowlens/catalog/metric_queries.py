"""Confusion, slice, extended and rank metrics over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.base import (
    MODELS,
    THRESHOLDS,
    count_sql,
    flows,
    line_flows,
    points_ctes,
    query,
    rounded,
)
from flowlens.operators import combine, metrics, rank_metrics
from flowlens.operators.score import routed_score, routed_score_strict

G = metrics.GLOBAL_SCOPE
CONF = f"""{count_sql("label = 1 AND prediction = 1")} AS tp, {count_sql("label = 0 AND prediction = 0")} AS tn,
  {count_sql("label = 0 AND prediction = 1")} AS fp, {count_sql("label = 1 AND prediction = 0")} AS fn"""


def ratios_sql(policy: str) -> str:
    if policy == "max1":
        p, r = "tp / greatest(tp + fp, 1)::DOUBLE", "tp / greatest(tp + fn, 1)::DOUBLE"
        f1 = f"2 * ({p}) * ({r}) / greatest(1e-12, ({p}) + ({r}))"
        fpr = "fp / greatest(fp + tn, 1)::DOUBLE"
    else:
        p, r = "tp / nullif(tp + fp, 0)::DOUBLE", "tp / nullif(tp + fn, 0)::DOUBLE"
        f1, fpr = "2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE", "fp / nullif(fp + tn, 0)::DOUBLE"
        if policy == "zero":
            p, r, f1, fpr = (f"coalesce({x}, 0)" for x in (p, r, f1, fpr))
    return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round({f1}, 6) AS f1, round({fpr}, 6) AS fpr"


# A-12
@query(f"SELECT protocol_hint, attack_family, {CONF} FROM flows GROUP BY 1, 2", ("flows",))
def confusion_counts(spark, sf):
    return metrics.confusion_counts(
        flows(spark, sf), label="label", pred="prediction", by=["protocol_hint", "attack_family"]
    )


# A-12 at volume, with the max1 ratio flavour
@query(f"""WITH c AS (SELECT source_relpath, {CONF} FROM (SELECT source_relpath, label,
      CAST(score >= 0.5 AS INTEGER) AS prediction FROM line_flows) GROUP BY 1)
  SELECT source_relpath, tp, tn, fp, fn, {ratios_sql("max1")} FROM c""", ("line_flows",))
def line_confusion(spark, sf):
    f = line_flows(spark, sf).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    c = metrics.confusion_counts(f, label="label", pred="prediction", by=["source_relpath"])
    return rounded(metrics.confusion_ratios(c, "max1"))


# L-01, L-02, A-15, F-10: flagship
@query(f"""WITH c AS (SELECT CASE WHEN grouping(protocol_used) = 1 THEN '{G}' ELSE protocol_used END AS scope, {CONF}
    FROM scored GROUP BY GROUPING SETS ((protocol_used), ()))
  SELECT scope, tp, tn, fp, fn, {ratios_sql("null")} FROM c""", ("flows", "scored"))
def routed_scope_metrics(spark, sf):
    scored = routed_score(flows(spark, sf), MODELS, THRESHOLDS)
    c = metrics.confusion_counts(scored, label="label", pred="prediction", by=["protocol_used"])
    return rounded(metrics.confusion_ratios(metrics.scope_rollup(c, "protocol_used", metrics.COUNTS)))


# L-02, P-18
@query("""SELECT source_row_index, protocol_used, round(score_attack, 6) AS score_attack, threshold, prediction,
  round(margin, 6) AS margin, round(abs_margin, 6) AS abs_margin FROM scored""", ("flows", "scored"))
def routed_score_rows(spark, sf):
    cols = ["source_row_index", "protocol_used", "score_attack", "threshold", "prediction", "margin", "abs_margin"]
    return rounded(routed_score(flows(spark, sf), MODELS, THRESHOLDS).select(*cols))


# L-01: unknown protocols are scored by the default model
@query("""SELECT protocol_used, count(*) AS rows, round(avg(s), 6) AS mean_score, count(*) FILTER (WHERE s >= t) AS alerts
  FROM (SELECT u AS protocol_used, CASE u WHEN 'wifi' THEN 0.55::DOUBLE ELSE 0.5 END AS t, CASE u WHEN 'wifi'
      THEN 1 / (1 + exp(-(-3.7::DOUBLE + 0.03::DOUBLE * value + 0.05::DOUBLE * k + 0.01::DOUBLE * hr)))
      ELSE 1 / (1 + exp(-(-3.5::DOUBLE + 0.025::DOUBLE * value + 0.055::DOUBLE * k + 0.005::DOUBLE * hr))) END AS s
    FROM (SELECT *, CASE WHEN protocol_hint = 'mqtt' THEN 'mqtt' ELSE 'wifi' END AS u FROM flows)) GROUP BY 1""",
  ("flows",))
def route_unknown(spark, sf):
    known = {p: MODELS[p] for p in ("wifi", "mqtt")}
    s = routed_score(flows(spark, sf), known, {p: THRESHOLDS[p] for p in known})
    return rounded(
        s.groupBy("protocol_used").agg(
            F.count("*").alias("rows"),
            F.avg("score_attack").alias("mean_score"),
            F.count(F.when(F.col("prediction") == 1, 1)).alias("alerts"),
        )
    )


# L-01, L-02: infinite features, some of which cancel to NaN, and protocols in mixed case, without thresholds: scores of 0.5
# and more are alerts, also where the log-odds are a rounding error below zero
@query("""WITH x AS (SELECT protocol_hint AS protocol_used,
      CASE WHEN source_row_index % 7 = 0 THEN 'inf'::DOUBLE ELSE value END AS v,
      CASE WHEN source_row_index % 5 = 0 THEN '-inf'::DOUBLE ELSE k END AS k, hr FROM flows),
    s AS (SELECT protocol_used, CASE protocol_used
        WHEN 'wifi' THEN -3.7::DOUBLE + 0.03::DOUBLE * v + 0.05::DOUBLE * k + 0.01::DOUBLE * hr
        WHEN 'mqtt' THEN -3.5::DOUBLE + 0.025::DOUBLE * v + 0.055::DOUBLE * k + 0.005::DOUBLE * hr
        ELSE -3.6::DOUBLE + 0.035::DOUBLE * v + 0.045::DOUBLE * k - 0.01::DOUBLE * hr END AS z FROM x),
    p AS (SELECT protocol_used, 1::DOUBLE / (1::DOUBLE + exp(-z)) AS score_attack FROM s)
  SELECT protocol_used, count(*) AS rows, count(*) FILTER (WHERE isnan(score_attack)) AS not_a_number,
    count(*) FILTER (WHERE NOT isnan(score_attack) AND score_attack >= 0.5::DOUBLE) AS alerts FROM p GROUP BY 1""", ("flows",))
def routed_score_not_finite(spark, sf):
    i, inf = F.col("source_row_index"), F.lit(float("inf"))
    f = flows(spark, sf).withColumns(
        {
            "value": F.when(i % 7 == 0, inf).otherwise(F.col("value")),
            "k": F.when(i % 5 == 0, -inf).otherwise(F.col("k")),
            "protocol_hint": F.when(i % 2 == 0, F.upper("protocol_hint")).otherwise(F.concat(F.lit(" "), F.initcap("protocol_hint"))),
        }
    )
    names = {"wifi": "WiFi", "mqtt": "MQTT", "bluetooth": "Bluetooth "}
    s = routed_score(f, {names[p]: m for p, m in MODELS.items()}, {})
    return s.groupBy("protocol_used").agg(
        F.count("*").alias("rows"),
        F.count(F.when(F.isnan("score_attack"), 1)).alias("not_a_number"),
        F.count(F.when(F.col("prediction") == 1, 1)).alias("alerts"),
    )


# L-03
@query("""SELECT protocol_used, count(*) AS rows, round(avg(score_attack), 6) AS mean_score FROM scored
  WHERE protocol_hint IN ('wifi', 'mqtt') GROUP BY 1""", ("flows", "scored"))
def routed_score_strict_rows(spark, sf):
    known = {p: MODELS[p] for p in ("wifi", "mqtt")}
    s = routed_score_strict(flows(spark, sf), known, {p: THRESHOLDS[p] for p in known})
    return rounded(s.groupBy("protocol_used").agg(F.count("*").alias("rows"), F.avg("score_attack").alias("mean_score")))


# A-13, A-14
@query(f"""WITH {points_ctes("flows", "attack_family", "score", G)},
  c AS (SELECT CASE WHEN grouping(attack_family) = 1 THEN '{G}' ELSE attack_family END AS scope, {CONF} FROM flows
    GROUP BY GROUPING SETS ((attack_family), ()))
  SELECT c.scope, tp, tn, fp, fn, tp + tn + fp + fn AS n, tn + fp AS n_benign, tp + fn AS n_attack,
    CAST(tn + fp = 0 OR tp + fn = 0 AS INTEGER) AS single_class_slice,
    CASE WHEN tn + fp = 0 OR tp + fn = 0 THEN 'single_class_slice' ELSE '' END AS slice_warning, {ratios_sql("zero")},
    round(roc_auc, 6) AS roc_auc, round(pr_auc_step, 6) AS pr_auc_step, round(pr_auc_trapz, 6) AS pr_auc_trapz
  FROM c LEFT JOIN ranks ON ranks.scope = c.scope""", ("flows",))
def slice_metrics(spark, sf):
    return rounded(
        metrics.slice_metrics(
            flows(spark, sf), label="label", pred="prediction", score="score", by="attack_family", with_global=True
        )
    )


# A-14: slices that hold one class only
@query(f"""WITH c AS (SELECT slice, {CONF} FROM (SELECT concat(protocol_hint, CASE WHEN value + k >= 90 THEN '_high'
      WHEN hr < 12 THEN '_low' ELSE '_late' END) AS slice, label, prediction FROM flows) GROUP BY 1)
  SELECT slice, tp, tn, fp, fn, tp + tn + fp + fn AS n, tn + fp AS n_benign, tp + fn AS n_attack,
    CAST(tn + fp = 0 OR tp + fn = 0 AS INTEGER) AS single_class_slice,
    CASE WHEN tn + fp = 0 OR tp + fn = 0 THEN 'single_class_slice' ELSE '' END AS slice_warning, {ratios_sql("null")} FROM c""",
  ("flows",))
def slice_flags(spark, sf):
    kind = (
        F.when(F.col("value") + F.col("k") >= 90, F.lit("_high")).when(F.col("hr") < 12, F.lit("_low")).otherwise("_late")
    )
    f = flows(spark, sf).withColumn("slice", F.concat("protocol_hint", kind))
    c = metrics.confusion_counts(f, label="label", pred="prediction", by=["slice"])
    return rounded(metrics.confusion_ratios(metrics.slice_flags(metrics.with_totals(c))))


EXT = f"""WITH {points_ctes("flows", "protocol_hint", "score", G)}, sx AS (
    SELECT protocol_hint AS scope, score, label, prediction FROM flows UNION ALL SELECT '{G}', score, label, prediction FROM flows),
  c AS (SELECT scope, {CONF}, count(*)::DOUBLE AS nn, avg(score) AS score_mean, stddev_pop(score) AS score_std,
      min(score) AS score_min, max(score) AS score_max, quantile_cont(score, 0.01) AS score_p01,
      quantile_cont(score, 0.05) AS score_p05, quantile_cont(score, 0.5) AS score_p50, quantile_cont(score, 0.95) AS score_p95,
      quantile_cont(score, 0.99) AS score_p99, avg(score) FILTER (WHERE label = 1) AS attack_score_mean,
      avg(score) FILTER (WHERE label = 0) AS benign_score_mean, avg((score - label) * (score - label)) AS brier_score,
      -avg(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))
        AS log_loss FROM sx GROUP BY scope),
  r AS (SELECT *, tp::DOUBLE AS a, tn::DOUBLE AS b, fp::DOUBLE AS c, fn::DOUBLE AS d, tp / nullif(tp + fp, 0)::DOUBLE AS pr,
      tp / nullif(tp + fn, 0)::DOUBLE AS rc, tn / nullif(tn + fp, 0)::DOUBLE AS sp, fp / nullif(fp + tn, 0)::DOUBLE AS fr,
      fn / nullif(fn + tp, 0)::DOUBLE AS fnr0, tn / nullif(tn + fn, 0)::DOUBLE AS np, (tp + tn) / nn AS acc,
      ((tp + fn) / nn) * ((tp + fp) / nn) + ((tn + fp) / nn) * ((tn + fn) / nn) AS ea FROM c)
  SELECT r.scope, tp, tn, fp, fn, CAST(nn AS BIGINT) AS n_rows, tp + fn AS support_attack, tn + fp AS support_benign,
    tp + fp AS predicted_attack, tn + fn AS predicted_benign, round(acc, 6) AS accuracy, round(pr, 6) AS precision,
    round(rc, 6) AS recall, round(sp, 6) AS specificity, round(2 * a / nullif(2 * a + c + d, 0), 6) AS f1,
    round(a / nullif(a + c + d, 0), 6) AS jaccard, round(fr, 6) AS fpr, round(fnr0, 6) AS fnr, round(np, 6) AS npv,
    round(c / nullif(c + a, 0), 6) AS fdr, round(d / nullif(d + b, 0), 6) AS false_omission_rate, round(rc, 6) AS tpr,
    round(sp, 6) AS tnr, round((a + d) / nn, 6) AS prevalence, round((a + c) / nn, 6) AS predicted_positive_rate,
    round((b + d) / nn, 6) AS predicted_negative_rate, round((rc + sp) / 2, 6) AS balanced_accuracy,
    round(1.25 * pr * rc / nullif(0.25 * pr + rc, 0), 6) AS f0_5, round(5 * pr * rc / nullif(4 * pr + rc, 0), 6) AS f2,
    round(sqrt(rc * sp), 6) AS gmean, round(rc + sp - 1, 6) AS youden_j, round(pr + np - 1, 6) AS markedness,
    round(rc / nullif(fr, 0), 6) AS lr_positive, round(fnr0 / nullif(sp, 0), 6) AS lr_negative,
    round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score, round(attack_score_mean, 6) AS attack_score_mean,
    round(benign_score_mean, 6) AS benign_score_mean, round(score_std, 6) AS score_std, round(score_mean, 6) AS score_mean,
    round(score_min, 6) AS score_min, round(score_max, 6) AS score_max,
    round((a * b - c * d) / nullif(sqrt((a + c) * (a + d) * (b + c) * (b + d)), 0), 6) AS mcc,
    round((acc - ea) / nullif(1 - ea, 0), 6) AS cohen_kappa,
    round((rc / nullif(fr, 0)) / nullif(fnr0 / nullif(sp, 0), 0), 6) AS diagnostic_odds_ratio,
    round(score_p01, 6) AS score_p01, round(score_p05, 6) AS score_p05, round(score_p50, 6) AS score_p50,
    round(score_p95, 6) AS score_p95, round(score_p99, 6) AS score_p99, round(roc_auc, 6) AS roc_auc,
    round(pr_auc_step, 6) AS pr_auc_step, round(pr_auc_trapz, 6) AS pr_auc_trapz
  FROM r JOIN ranks ON ranks.scope = r.scope"""


# A-16, A-17
@query(EXT, ("flows",))
def extended_metrics(spark, sf):
    return rounded(
        metrics.extended_metrics(
            flows(spark, sf), label="label", pred="prediction", score="score", by="protocol_hint"
        )
    )


ADV = "CAST(round(score * 0.9::DOUBLE, 6) >= threshold AS INTEGER)"
ADV_UP = "CAST(round(least(1::DOUBLE, score * 1.1::DOUBLE), 6) >= threshold AS INTEGER)"


# A-18
@query(f"""WITH s AS (SELECT protocol_hint, label, prediction, {ADV} AS adv FROM flows), c AS (SELECT protocol_hint,
    count(*) FILTER (WHERE label = 1 AND adv = 0) AS asr_all_num, count(*) FILTER (WHERE label = 1) AS asr_all_den,
    count(*) FILTER (WHERE label = 1 AND prediction = 1 AND adv = 0) AS asr_conditional_num,
    count(*) FILTER (WHERE label = 1 AND prediction = 1) AS asr_conditional_den FROM s GROUP BY 1)
  SELECT *, round(asr_all_num / nullif(asr_all_den, 0)::DOUBLE, 6) AS asr_all,
    round(asr_conditional_num / nullif(asr_conditional_den, 0)::DOUBLE, 6) AS asr_conditional FROM c""", ("flows",))
def attack_success(spark, sf):
    adv = (F.round(F.col("score") * F.lit(0.9), 6) >= F.col("threshold")).cast("int")
    f = flows(spark, sf).withColumn("adv", adv)
    return rounded(metrics.attack_success(f, label="label", baseline="prediction", attacked="adv", by=["protocol_hint"]))


# A-19
@query(f"""WITH s AS (SELECT protocol_hint, label, prediction, {ADV_UP} AS adv FROM flows), c AS (SELECT protocol_hint,
    count(*) FILTER (WHERE label = 0 AND adv = 1) AS fp_attack_rate_num, count(*) FILTER (WHERE label = 0) AS fp_attack_rate_den,
    count(*) FILTER (WHERE label = 0 AND prediction = 0 AND adv = 1) AS fp_attack_rate_conditional_num,
    count(*) FILTER (WHERE label = 0 AND prediction = 0) AS fp_attack_rate_conditional_den FROM s GROUP BY 1)
  SELECT *, round(fp_attack_rate_num / nullif(fp_attack_rate_den, 0)::DOUBLE, 6) AS fp_attack_rate,
    round(fp_attack_rate_conditional_num / nullif(fp_attack_rate_conditional_den, 0)::DOUBLE, 6)
      AS fp_attack_rate_conditional FROM c""", ("flows",))
def false_positive_attack(spark, sf):
    adv = (F.round(F.least(F.lit(1.0), F.col("score") * F.lit(1.1)), 6) >= F.col("threshold")).cast("int")
    f = flows(spark, sf).withColumn("adv", adv)
    return rounded(
        metrics.false_positive_attack(f, label="label", baseline="prediction", attacked="adv", by=["protocol_hint"])
    )


# A-20: partial counts per capture, merged later
@query(f"SELECT protocol_hint, {CONF} FROM flows GROUP BY 1", ("flows",))
def merged_counts(spark, sf):
    per = metrics.confusion_counts(
        flows(spark, sf), label="label", pred="prediction", by=["protocol_hint", "source_relpath"]
    )
    return metrics.merge_counts(per, by=["protocol_hint"])


# A-23
@query("""WITH s AS (SELECT protocol_hint, attack_family, hr, count(*) FILTER (WHERE label = 0 AND prediction = 1)
      / nullif(count(*) FILTER (WHERE label = 0), 0)::DOUBLE AS fpr, count(*) FILTER (WHERE label = 1 AND prediction = 1)
      / nullif(count(*) FILTER (WHERE label = 1), 0)::DOUBLE AS rec FROM flows GROUP BY 1, 2, 3),
    q AS (SELECT protocol_hint, concat(attack_family, '@', CAST(CAST(hr AS INTEGER) AS VARCHAR)) AS key, round(fpr, 9) AS fpr,
      round(rec, 9) AS rec, round((fpr + rec) / 2, 9) AS f1 FROM s)
  SELECT protocol_hint, max(fpr) AS worst_attacked_benign_fpr,
    (SELECT min(key) FROM q x WHERE x.protocol_hint = q.protocol_hint AND x.fpr = max(q.fpr)) AS worst_attacked_benign_fpr_key,
    min(rec) AS worst_adv_malicious_recall,
    (SELECT min(key) FROM q x WHERE x.protocol_hint = q.protocol_hint AND x.rec = min(q.rec)) AS worst_adv_recall_key,
    min(f1) AS worst_robust_f1,
    (SELECT min(key) FROM q x WHERE x.protocol_hint = q.protocol_hint AND x.f1 = min(q.f1)) AS worst_robust_f1_key
  FROM q GROUP BY protocol_hint""", ("flows",))
def worst_case(spark, sf):
    c = metrics.confusion_counts(
        flows(spark, sf), label="label", pred="prediction", by=["protocol_hint", "attack_family", "hr"]
    )
    m = metrics.confusion_ratios(c)
    s = m.select(
        "protocol_hint",
        F.concat_ws("@", "attack_family", F.col("hr").cast("int").cast("string")).alias("key"),
        F.round("fpr", 9).alias("fpr"),
        F.round("recall", 9).alias("rec"),
        F.round((F.col("fpr") + F.col("recall")) / 2, 9).alias("f1"),
    )
    return metrics.worst_case(s, by=["protocol_hint"], key="key", fpr="fpr", recall="rec", f1="f1")


# J-06
@query("""WITH s AS (SELECT protocol_hint AS scope, attack_family AS method, avg(score) AS m, avg(label) AS a FROM flows
    GROUP BY 1, 2), b AS (SELECT scope, min(method) AS method FROM s GROUP BY 1)
  SELECT s.scope, s.method, round(s.m, 6) AS m, round(s.a, 6) AS a, round(s.m - x.m, 6) AS delta_m,
    round(s.a - x.a, 6) AS delta_a
  FROM s JOIN b ON b.scope = s.scope JOIN s x ON x.scope = b.scope AND x.method = b.method""", ("flows",))
def baseline_delta(spark, sf):
    s = flows(spark, sf).groupBy(F.col("protocol_hint").alias("scope"), F.col("attack_family").alias("method")).agg(
        F.avg("score").alias("m"), F.avg("label").alias("a")
    )
    base = F.col("method").isin("click", "signup", "purchase")
    return rounded(combine.baseline_delta(s, scope=["scope"], is_baseline=base, measures=["m", "a"]))


# J-07
@query("""SELECT protocol_hint, CAST(hr AS INTEGER) AS hour, round(avg(score) FILTER (WHERE split = 'train'), 6) AS s_before,
    round(avg(score) FILTER (WHERE split = 'test'), 6) AS s_after,
    round(avg(score) FILTER (WHERE split = 'test') - avg(score) FILTER (WHERE split = 'train'), 6) AS s_delta
  FROM flows GROUP BY 1, 2""", ("flows",))
def policy_compare(spark, sf):
    m = flows(spark, sf).groupBy("protocol_hint", F.col("hr").cast("int").alias("hour"), "split").agg(
        F.avg("score").alias("s")
    )
    return rounded(
        combine.policy_compare(
            m, key=["protocol_hint", "hour"], policy="split", before="train", after="test", measures=["s"]
        )
    )


# W-01
@query(f"""WITH {points_ctes("flows", "protocol_hint", "k_score")}
  SELECT scope, score, pos, neg, tp, fp, n_pos, n_neg, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM rates""", ("flows",))
def roc_curve_points(spark, sf):
    return rounded(rank_metrics.roc_points(flows(spark, sf), by="protocol_hint", score="k_score", label="label"))


AUCS = "SELECT scope, round(roc_auc, 6) AS roc_auc, round(pr_auc_step, 6) AS pr_auc_step, round(pr_auc_trapz, 6) AS pr_auc_trapz FROM ranks"


# W-02, W-03, W-04
@query(f"WITH {points_ctes('flows', 'protocol_hint', 'k_score', G)} {AUCS}", ("flows",))
def rank_metrics_ties(spark, sf):
    return rounded(
        rank_metrics.rank_metrics(
            flows(spark, sf), by="protocol_hint", score="k_score", label="label", with_global=G
        )
    )


@query(f"WITH {points_ctes('line_flows', 'protocol_hint', 'score', G)} {AUCS}", ("line_flows",))
def line_rank_metrics(spark, sf):
    return rounded(
        rank_metrics.rank_metrics(line_flows(spark, sf), by="protocol_hint", score="score", label="label", with_global=G)
    )


# W-02, rank flavour
@query("""WITH r AS (SELECT protocol_hint AS scope, label, (rank() OVER (PARTITION BY protocol_hint ORDER BY k_score) +
      (count(*) OVER (PARTITION BY protocol_hint, k_score) - 1) / 2::DOUBLE) AS rk FROM flows),
    a AS (SELECT scope, sum(rk) FILTER (WHERE label = 1) AS s, count(*) FILTER (WHERE label = 1)::DOUBLE AS p,
      count(*) FILTER (WHERE label = 0)::DOUBLE AS q FROM r GROUP BY 1)
  SELECT scope, round((s - p * (p + 1) / 2) / (p * q), 6) AS roc_auc FROM a""", ("flows",))
def roc_auc_by_rank(spark, sf):
    return rounded(rank_metrics.roc_auc_rank(flows(spark, sf), by="protocol_hint", score="k_score", label="label"))


# W-05
@query("""WITH r AS (SELECT protocol_hint AS scope, label, CAST(sum(label) OVER w AS DOUBLE) AS tp, count(*) OVER w AS n
    FROM flows WINDOW w AS (PARTITION BY protocol_hint ORDER BY k_score DESC, label DESC, source_row_index
      ROWS UNBOUNDED PRECEDING))
  SELECT scope, round(sum(tp / n) FILTER (WHERE label = 1) / nullif(sum(label), 0), 6) AS average_precision FROM r GROUP BY 1""",
  ("flows",))
def average_precision_rowwise(spark, sf):
    return rounded(
        rank_metrics.average_precision_rowwise(flows(spark, sf), by="protocol_hint", score="k_score", label="label")
    )
