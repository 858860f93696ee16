"""Ranking and escalation over candidate rows aggregated from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.base import PROTOCOLS, candidates, query, rounded
from flowlens.operators import combine, decide, reports

RANK = """row_number() OVER (PARTITION BY protocol ORDER BY gate_pass DESC, attacked_benign_fpr, clean_fpr,
  adv_malicious_recall DESC, clean_f1 DESC, robust_f1 DESC, model_name, family_id, seed)"""


def ranked_global(spark, sf):
    return decide.rank_global(decide.global_candidates(candidates(spark, sf), protocols=PROTOCOLS))


# P-23
@query("""SELECT DISTINCT concat(model_name, '__', family_id, '__', CAST(seed AS VARCHAR)) AS candidate_key, model_name, family_id,
  CAST(seed AS INTEGER) AS seed FROM cand""", ("cand",))
def candidate_keys(spark, sf):
    keys = candidates(spark, sf).select(decide.candidate_key("model_name", "family_id", "seed").alias("candidate_key"))
    return keys.distinct().select("candidate_key", *decide.split_candidate_key("candidate_key"))


# W-16
@query(f"SELECT protocol, model_name, family_id, CAST(seed AS INTEGER) AS seed, gate_pass, gate_failure_category, {RANK} AS final_rank FROM cand",
       ("cand",))
def rank_candidates(spark, sf):
    r = decide.rank_candidates(candidates(spark, sf), by=["protocol"], tie=["model_name", "family_id", "seed"])
    return r.select(
        "protocol", "model_name", "family_id", F.col("seed").cast("int").alias("seed"), "gate_pass",
        "gate_failure_category", "final_rank",
    )


GCOLS = """candidate_key, candidate_group_key, protocols_present, has_all_protocols, gate_pass, gate_failure_category,
  round(worst_attacked_benign_fpr, 6) AS worst_attacked_benign_fpr, round(worst_clean_fpr, 6) AS worst_clean_fpr,
  round(worst_adv_malicious_recall, 6) AS worst_adv_malicious_recall, round(mean_clean_f1, 6) AS mean_clean_f1,
  round(mean_robust_f1, 6) AS mean_robust_f1"""


# A-30
@query(f"SELECT {GCOLS} FROM gcand", ("cand", "gcand"))
def global_candidates(spark, sf):
    g = decide.global_candidates(candidates(spark, sf), protocols=PROTOCOLS)
    return rounded(g.drop("model_name", "family_id", "seed"))


# A-30: candidates that lack a protocol
@query("""WITH c2 AS (SELECT * FROM cand WHERE NOT (protocol = 'mqtt' AND model_name = 'mlp'))
  SELECT concat(model_name, '__', family_id, '__', CAST(seed AS VARCHAR)) AS candidate_key, count(*) = 3 AS has_all_protocols,
    CASE WHEN count(*) < 3 THEN 'missing_protocol_rows' WHEN bool_and(gate_pass) THEN 'none'
      ELSE array_to_string(list_sort(list(DISTINCT gate_failure_category) FILTER (WHERE gate_failure_category <> 'none')), ';')
      END AS gate_failure_category FROM c2 GROUP BY model_name, family_id, seed""", ("cand",))
def global_candidates_missing(spark, sf):
    c = candidates(spark, sf).where(~((F.col("protocol") == "mqtt") & (F.col("model_name") == "mlp")))
    g = decide.global_candidates(c, protocols=PROTOCOLS)
    return g.select("candidate_key", "has_all_protocols", "gate_failure_category")


# W-17
@query("SELECT candidate_key, gate_pass, final_rank FROM granked", ("cand", "gcand"))
def rank_global(spark, sf):
    return ranked_global(spark, sf).select("candidate_key", "gate_pass", "final_rank")


# W-18, J-11
@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY candidate_group_key ORDER BY final_rank) AS g FROM granked
      WHERE model_name IN ('xgboost', 'catboost')), l AS (SELECT *, CAST(row_number() OVER (PARTITION BY model_name
      ORDER BY final_rank) > 1 AS INTEGER) AS picked_by_rank FROM o WHERE g = 1)
  SELECT candidate_group_key, picked_by_rank, CASE family_id WHEN 'F' THEN 'balanced' ELSE 'unknown' END AS family_name
  FROM l ORDER BY picked_by_rank, final_rank LIMIT 3""", ("cand", "gcand"))
def shortlist_diverse(spark, sf):
    names = spark.createDataFrame([("F", "balanced")], "family_id string, family_name string")
    s = decide.shortlist(ranked_global(spark, sf), k=3, models=["xgboost", "catboost"], names=names)
    return s.select("candidate_group_key", "picked_by_rank", "family_name")


STAB = """coarse AS (SELECT * FROM granked WHERE seed = 42), stab AS (SELECT candidate_group_key, gate_pass AS global_gate_pass
  FROM granked WHERE seed <> 42), ss AS (SELECT s.candidate_group_key, bool_and(s.global_gate_pass) AND
      coalesce(bool_or(c.gate_pass), false) AS consistent_gate_pass,
    coalesce(bool_or(c.gate_pass), false) OR bool_or(s.global_gate_pass) AS any_seed_pass,
    count(*) + 1 AS num_seeds_checked FROM stab s
  LEFT JOIN (SELECT candidate_group_key, bool_or(gate_pass) AS gate_pass FROM coarse GROUP BY 1) c
    ON c.candidate_group_key = s.candidate_group_key GROUP BY 1)"""


def stability_parts(spark, sf):
    g = ranked_global(spark, sf)
    coarse = g.where(F.col("seed") == 42)
    seeds = g.where(F.col("seed") != 42).select("candidate_group_key", F.col("gate_pass").alias("global_gate_pass"))
    return coarse, seeds


# J-09, A-31
@query(f"WITH {STAB} SELECT * FROM ss", ("cand", "gcand"))
def stability_summary(spark, sf):
    return decide.stability_summary(*stability_parts(spark, sf))


# A-33
@query("SELECT protocol, NOT bool_or(num_gate_pass > 0) AS hard_cap FROM cand GROUP BY 1", ("cand",))
def protocol_hard_cap(spark, sf):
    return decide.protocol_hard_cap(candidates(spark, sf))


ESC = f"""{STAB}, e AS (SELECT (SELECT coalesce(bool_or(consistent_gate_pass), false) FROM ss) AS stable,
    (SELECT bool_or(h) FROM (SELECT NOT bool_or(num_gate_pass > 0) AS h FROM cand GROUP BY protocol)) AS tuning_infeasible,
    (SELECT bool_or(contains(gate_failure_category, 'data_cap_infeasible')) FROM cand) AS cap,
    (SELECT bool_or(gate_pass) FROM coarse) AS anyg, (SELECT count(*) > 0 FROM ss) AS checked),
  esc AS (SELECT NOT stable AS triggered, CASE WHEN stable THEN 'none' WHEN cap THEN 'data_cap_infeasible'
      WHEN tuning_infeasible THEN 'tuning_infeasible' WHEN checked AND anyg THEN 'stability_infeasible'
      ELSE 'no_stable_candidate' END AS reason, tuning_infeasible FROM e)"""


# A-32
@query(f"WITH {ESC} SELECT * FROM esc", ("cand", "gcand"))
def escalation_reason(spark, sf):
    coarse, seeds = stability_parts(spark, sf)
    return decide.escalation(candidates(spark, sf), coarse, seeds)


# A-29
@query("""SELECT model_name, family_id, round(sum(clean_f1 * n_val) / sum(n_val), 6) AS weighted_objective,
  round(avg(CAST(gate_pass AS DOUBLE)), 6) AS feasible_ratio, count(*) AS protocols FROM cand GROUP BY 1, 2""", ("cand",))
def weighted_mean_objective(spark, sf):
    return rounded(
        decide.weighted_objective(
            candidates(spark, sf), by=["model_name", "family_id"], objective="clean_f1", weight="n_val", feasible="gate_pass"
        )
    )


# L-11
@query("""SELECT protocol, model_name, family_id, CAST(seed AS INTEGER) AS seed, round(clean_f1, 6) AS clean_f1, row_number() OVER (PARTITION BY protocol
  ORDER BY clean_f1 DESC, model_name, family_id, seed) AS rank FROM cand""", ("cand",))
def model_leaderboard(spark, sf):
    r = decide.leaderboard(
        candidates(spark, sf), by=["protocol"], primary="clean_f1", tie=["model_name", "family_id", "seed"]
    )
    return rounded(r.select("protocol", "model_name", "family_id", F.col("seed").cast("int").alias("seed"), "clean_f1", "rank"))


# L-17
@query(f"""WITH {ESC} SELECT g.candidate_key, g.final_rank, g.gate_pass, coalesce(ss.consistent_gate_pass, false) AS stable,
    esc.triggered AS escalated, esc.reason AS escalation_reason
  FROM (SELECT * FROM granked ORDER BY final_rank LIMIT 10) g LEFT JOIN ss ON ss.candidate_group_key = g.candidate_group_key,
    esc""", ("cand", "gcand"))
def consolidated_report(spark, sf):
    coarse, seeds = stability_parts(spark, sf)
    out = reports.consolidated_report(
        ranked_global(spark, sf),
        decide.stability_summary(coarse, seeds),
        decide.escalation(candidates(spark, sf), coarse, seeds),
    )
    return out.select("candidate_key", "final_rank", "gate_pass", "stable", "escalated", "escalation_reason")


# J-07: two policies (seeds) side by side
@query("""SELECT model_name, family_id, protocol, max(clean_f1) FILTER (WHERE seed = 42) AS clean_f1_before,
    max(clean_f1) FILTER (WHERE seed = 43) AS clean_f1_after,
    round(max(clean_f1) FILTER (WHERE seed = 43) - max(clean_f1) FILTER (WHERE seed = 42), 6) AS clean_f1_delta
  FROM cand GROUP BY 1, 2, 3""", ("cand",))
def seed_compare(spark, sf):
    c = candidates(spark, sf).withColumn("seed", F.col("seed").cast("string"))
    return rounded(
        combine.policy_compare(
            c, key=["model_name", "family_id", "protocol"], policy="seed", before="42", after="43", measures=["clean_f1"]
        )
    )
