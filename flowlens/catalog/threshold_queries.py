"""Threshold searches and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.base import flows, grid_ctes, points_ctes, pools, query, rounded
from flowlens.operators import profile, thresholds
from flowlens.operators.rank_metrics import roc_points

MAX_FPR = 0.05
PTS = points_ctes("flows", "protocol_hint", "score")


def curve(spark, sf):
    return roc_points(flows(spark, sf), by="protocol_hint", score="score", label="label")


START = """allp AS (SELECT scope, score, tp, fp, n_pos, n_neg, tpr, fpr FROM rates
  UNION ALL SELECT scope, 'inf'::DOUBLE, 0, 0, max(n_pos), max(n_neg), 0, 0 FROM rates GROUP BY scope)"""


# W-06
@query(f"""WITH {PTS}, ok AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY tpr DESC, score ASC) AS rn FROM rates
    WHERE fpr <= {MAX_FPR}::DOUBLE)
  SELECT s.scope, coalesce(ok.score, 1) AS threshold, round(coalesce(ok.tpr, 0), 6) AS recall,
    round(coalesce(ok.fpr, 0), 6) AS fpr FROM (SELECT DISTINCT scope FROM rates) s
    LEFT JOIN ok ON ok.scope = s.scope AND ok.rn = 1""", ("flows",))
def max_recall_lowest(spark, sf):
    return rounded(thresholds.max_recall_at_fpr_lowest(curve(spark, sf), MAX_FPR))


# W-07
@query(f"""WITH {PTS}, {START} SELECT scope, score AS threshold, round(tpr, 6) AS recall, round(fpr, 6) AS fpr FROM allp
  WHERE fpr <= {MAX_FPR}::DOUBLE QUALIFY row_number() OVER (PARTITION BY scope ORDER BY tpr DESC, score DESC) = 1""",
  ("flows",))
def max_recall_highest(spark, sf):
    return rounded(thresholds.max_recall_at_fpr_highest(curve(spark, sf), MAX_FPR))


BEST_F1 = f"""{START}, f AS (SELECT *, 2 * tp / (tp + fp + n_pos)::DOUBLE AS f1,
    coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS prec1 FROM allp WHERE fpr <= {MAX_FPR}::DOUBLE),
  best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY scope ORDER BY f1 DESC, score DESC) = 1)"""
BEST_COLS = """b.scope, b.score AS threshold, round(b.fpr, 6) AS val_fpr, round(b.tpr, 6) AS val_recall,
  round(b.prec1, 6) AS val_precision, round(b.f1, 6) AS val_f1, 1::DOUBLE AS feasible"""


# W-08
@query(f"WITH {PTS}, {BEST_F1} SELECT {BEST_COLS} FROM best b", ("flows",))
def max_f1_at_fpr(spark, sf):
    return rounded(thresholds.max_f1_at_fpr(curve(spark, sf), MAX_FPR))


# W-09
@query(f"""WITH {PTS}, {BEST_F1} SELECT {BEST_COLS}, round(pr_auc_step, 6) AS val_pr_auc,
    round(greatest(0, b.fpr - {MAX_FPR}::DOUBLE), 6) AS fpr_gap, round(0.1 * b.fpr / {MAX_FPR}, 6) AS soft_fpr_penalty,
    round(b.f1 + 0.05 * pr_auc_step - 0.1 * b.fpr / {MAX_FPR} - 4 * greatest(0, b.fpr - {MAX_FPR}::DOUBLE), 6) AS objective
  FROM best b JOIN ranks r ON r.scope = b.scope""", ("flows",))
def validation_objective(spark, sf):
    return rounded(thresholds.validation_objective(curve(spark, sf), MAX_FPR))


@query(f"""WITH {PTS}, {BEST_F1},
    lo AS (SELECT scope, score FROM rates WHERE fpr <= {MAX_FPR}::DOUBLE
      QUALIFY row_number() OVER (PARTITION BY scope ORDER BY tpr DESC, score ASC) = 1),
    hi AS (SELECT scope, score FROM allp WHERE fpr <= {MAX_FPR}::DOUBLE
      QUALIFY row_number() OVER (PARTITION BY scope ORDER BY tpr DESC, score DESC) = 1)
  SELECT lo.scope, lo.score AS lowest_threshold, hi.score AS highest_threshold, best.score AS f1_threshold
  FROM lo JOIN hi ON hi.scope = lo.scope JOIN best ON best.scope = lo.scope""", ("flows",))
def threshold_sweep(spark, sf):
    return thresholds.threshold_sweep(flows(spark, sf), by="protocol_hint", score="score", label="label", max_fpr=MAX_FPR)


POINTS = 101


def grid_eval(spark, sf):
    p = pools(spark, sf)
    return thresholds.evaluate_grid(p, thresholds.threshold_grid(p, points=POINTS, base=0.5), POINTS)


# W-10
@query(f"WITH {grid_ctes(POINTS, 0.5)} SELECT DISTINCT scope, round(threshold, 9) AS threshold FROM grid",
       ("flows", "pools"))
def threshold_grid(spark, sf):
    g = thresholds.threshold_grid(pools(spark, sf), points=POINTS, base=0.5)
    return rounded(g.select("scope", F.explode("grid").alias("threshold")), 9)


# W-11
@query(f"""WITH {grid_ctes(POINTS, 0.5)} SELECT scope, round(threshold, 9) AS threshold, tp, fp, adv_fp, adv_tp, n_pos, n_neg,
    n_adv_benign, n_adv_malicious, round(clean_precision, 9) AS clean_precision, round(clean_recall, 9) AS clean_recall,
    round(clean_f1, 9) AS clean_f1, round(clean_fpr, 9) AS clean_fpr, round(attacked_benign_fpr, 9) AS attacked_benign_fpr,
    round(attacked_malicious_recall, 9) AS attacked_malicious_recall FROM ev""", ("flows", "pools"))
def evaluate_grid(spark, sf):
    return rounded(grid_eval(spark, sf), 9)


# W-12
@query(f"""WITH {grid_ctes(POINTS, 0.5)}, s AS (SELECT *, greatest(0, 0.8::DOUBLE - clean_recall) AS rs,
      greatest(0, 0.7::DOUBLE - attacked_malicious_recall) AS ars,
      clean_recall >= 0.8::DOUBLE AND attacked_malicious_recall >= 0.7::DOUBLE AS ok,
      count(*) OVER (PARTITION BY scope) AS num_candidates FROM ev),
    t AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY scope) AS num_feasible,
      clean_f1 - 3 * attacked_benign_fpr - 2 * rs - 1.5::DOUBLE * ars AS fb FROM s),
    a AS (SELECT *, 'feasible' AS selection_mode FROM t WHERE ok QUALIFY row_number() OVER (PARTITION BY scope
      ORDER BY attacked_benign_fpr, ars, clean_f1 DESC, threshold DESC) = 1),
    b AS (SELECT *, 'fallback' AS selection_mode FROM t WHERE num_feasible = 0 QUALIFY row_number() OVER (PARTITION BY scope
      ORDER BY fb DESC, attacked_benign_fpr, threshold) = 1)
  SELECT scope, round(threshold, 9) AS selected_threshold, selection_mode, round(clean_f1, 9) AS clean_f1,
    round(clean_recall, 9) AS clean_recall, round(attacked_benign_fpr, 9) AS attacked_benign_fpr,
    round(attacked_malicious_recall, 9) AS attacked_malicious_recall, num_candidates, num_feasible
  FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""", ("flows", "pools"))
def select_threshold_feasible(spark, sf):
    out = thresholds.select_feasible(
        grid_eval(spark, sf), recall_target=0.8, adv_recall_target=0.7, adv_weight=1.5
    )
    return rounded(out, 9)


def gated_sql(clean: float, attacked: float, recall: float, margin: float) -> str:
    inner = attacked * margin
    return f"""WITH {grid_ctes(POINTS, 0.5)}, g0 AS (SELECT *, clean_fpr <= {clean}::DOUBLE AS c_ok,
      attacked_benign_fpr <= {attacked}::DOUBLE AS a_ok, attacked_benign_fpr <= {inner!r}::DOUBLE AS i_ok,
      attacked_malicious_recall >= {recall}::DOUBLE AS r_ok,
      greatest(0, {recall}::DOUBLE - attacked_malicious_recall) AS shortfall FROM ev),
    g AS (SELECT *, count(*) OVER w AS num_candidates, count(*) FILTER (WHERE c_ok AND i_ok AND r_ok) OVER w AS n_in,
      count(*) FILTER (WHERE c_ok AND a_ok AND r_ok) OVER w AS n_gate FROM g0 WINDOW w AS (PARTITION BY scope)),
    m1 AS (SELECT *, 'internal_margin_gate_pass_lexicographic' AS selection_mode FROM g WHERE n_in > 0 AND c_ok AND i_ok AND r_ok
      QUALIFY row_number() OVER (PARTITION BY scope ORDER BY attacked_benign_fpr, clean_fpr, attacked_malicious_recall DESC,
        clean_f1 DESC, threshold DESC) = 1),
    m2 AS (SELECT *, 'gate_pass_lexicographic' AS selection_mode FROM g WHERE n_in = 0 AND n_gate > 0 AND c_ok AND a_ok AND r_ok
      QUALIFY row_number() OVER (PARTITION BY scope ORDER BY attacked_benign_fpr, clean_fpr, attacked_malicious_recall DESC,
        clean_f1 DESC, threshold DESC) = 1),
    m3 AS (SELECT *, 'no_pass_adv_priority' AS selection_mode FROM g WHERE n_gate = 0 QUALIFY row_number() OVER (
      PARTITION BY scope ORDER BY shortfall, attacked_benign_fpr, clean_fpr, clean_f1 DESC, threshold DESC) = 1)
  SELECT scope, round(threshold, 9) AS selected_threshold, selection_mode, c_ok AND a_ok AND r_ok AS gate_pass,
    CASE WHEN NOT (c_ok AND a_ok) AND NOT r_ok THEN 'both' WHEN NOT (c_ok AND a_ok) THEN 'fpr_only'
      WHEN NOT r_ok THEN 'adv_recall_only' ELSE 'none' END AS gate_failure_category, round(shortfall, 9) AS adv_shortfall,
    round(clean_f1, 9) AS clean_f1, round(clean_fpr, 9) AS clean_fpr, round(clean_recall, 9) AS clean_recall,
    round(attacked_benign_fpr, 9) AS attacked_benign_fpr, round(attacked_malicious_recall, 9) AS attacked_malicious_recall,
    num_candidates, n_in AS num_internal_gate_pass, n_gate AS num_gate_pass
  FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"""


def gated(spark, sf, clean, attacked, recall, margin):
    g = thresholds.gate_candidates(
        grid_eval(spark, sf), clean_fpr_max=clean, attacked_fpr_max=attacked, adv_recall_min=recall, margin=margin
    )
    return rounded(thresholds.select_gated(g), 9)


# W-13, W-15: one query per selection mode
@query(gated_sql(0.2, 0.25, 0.7, 0.9), ("flows", "pools"))
def select_threshold_gated_internal(spark, sf):
    return gated(spark, sf, 0.2, 0.25, 0.7, 0.9)


@query(gated_sql(0.2, 0.25, 0.7, 0.05), ("flows", "pools"))
def select_threshold_gated_pass(spark, sf):
    return gated(spark, sf, 0.2, 0.25, 0.7, 0.05)


@query(gated_sql(0.001, 0.001, 0.99, 0.9), ("flows", "pools"))
def select_threshold_gated_none(spark, sf):
    return gated(spark, sf, 0.001, 0.001, 0.99, 0.9)


# W-14
@query(f"""WITH {grid_ctes(300, None, clip=False)}, o AS (SELECT *, clean_f1 - 4 * greatest(0, clean_fpr - {MAX_FPR}::DOUBLE)
      AS objective FROM ev)
  SELECT scope, round(threshold, 9) AS base_threshold, round(objective, 9) AS objective, round(clean_f1, 9) AS clean_f1,
    round(clean_fpr, 9) AS clean_fpr FROM o
  QUALIFY row_number() OVER (PARTITION BY scope ORDER BY objective DESC, threshold) = 1""", ("flows", "pools"))
def select_base_threshold(spark, sf):
    return rounded(thresholds.select_base(pools(spark, sf), max_fpr=MAX_FPR), 9)


# W-15, A-28: too few validation benign rows override the gate
@query("""WITH v AS (SELECT source_relpath, count(*) FILTER (WHERE label = 0) AS val_rows,
      count(*) FILTER (WHERE label = 0 AND prediction = 1) / nullif(count(*) FILTER (WHERE label = 0), 0)::DOUBLE AS fpr,
      count(*) FILTER (WHERE label = 1 AND prediction = 1) / nullif(count(*) FILTER (WHERE label = 1), 0)::DOUBLE AS rec
    FROM flows GROUP BY 1), g AS (SELECT *, coalesce(fpr <= 0.2::DOUBLE, false) AS f_ok, coalesce(rec >= 0.8::DOUBLE, false)
      AS r_ok, val_rows >= 30 AS feasible FROM v)
  SELECT source_relpath, val_rows, feasible AS strict_fpr_feasible, f_ok AND r_ok AND feasible AS gate_pass,
    CASE WHEN NOT feasible THEN 'data_cap_infeasible' WHEN NOT f_ok AND NOT r_ok THEN 'both' WHEN NOT f_ok THEN 'fpr_only'
      WHEN NOT r_ok THEN 'adv_recall_only' ELSE 'none' END AS gate_failure_category FROM g""", ("flows",))
def gate_category_override(spark, sf):
    y, p = F.col("label"), F.col("prediction")
    v = flows(spark, sf).groupBy("source_relpath").agg(
        F.count(F.when(y == 0, 1)).alias("val_rows"),
        F.avg(F.when(y == 0, p)).alias("fpr"),
        F.avg(F.when(y == 1, p)).alias("rec"),
    )
    v = profile.fpr_feasibility(v, max_fpr=1.0 / 30)
    f_ok = F.coalesce(F.col("fpr") <= 0.2, F.lit(False))
    r_ok = F.coalesce(F.col("rec") >= 0.8, F.lit(False))
    g = v.withColumns(
        {"gate_pass": f_ok & r_ok, "gate_failure_category": thresholds.gate_category(f_ok, F.lit(True), r_ok)}
    )
    return thresholds.data_cap_override(g).select(
        "source_relpath", "val_rows", "strict_fpr_feasible", "gate_pass", "gate_failure_category"
    )
