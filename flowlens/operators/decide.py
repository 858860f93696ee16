"""Ranking of candidate models over gates, protocols and seeds. Inputs are metric tables, one row per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.numeric import ratio
from flowlens.plans.small import null_safe_join


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def candidate_key(*parts: str) -> Column:
    return F.concat_ws("__", *[F.col(p).cast("string") for p in parts])


def split_candidate_key(key: str) -> list[Column]:
    cut = F.split(F.col(key), "__")
    return [
        F.get(cut, F.lit(0)).alias("model_name"),
        F.get(cut, F.lit(1)).alias("family_id"),
        F.get(cut, F.lit(2)).cast("int").alias("seed"),
    ]


def rank_candidates(df: DataFrame, *, by: list[str], tie: list[str]) -> DataFrame:
    """Gate first, then attacked FPR, clean FPR, adversarial recall, clean F1, robust F1; non-finite last."""
    order = [
        F.col("gate_pass").desc(),
        _finite("attacked_benign_fpr").asc_nulls_last(),
        _finite("clean_fpr").asc_nulls_last(),
        _finite("adv_malicious_recall").desc_nulls_last(),
        _finite("clean_f1").desc_nulls_last(),
        _finite("robust_f1").desc_nulls_last(),
        *[F.col(t) for t in tie],
    ]
    return df.withColumn("final_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def global_candidates(df: DataFrame, *, protocols: list[str]) -> DataFrame:
    """One row per model, family and seed over all protocols.

    The gate is the AND over protocols. A candidate without rows for every protocol fails with NULL measures.
    Failure categories come from a fixed set of five, so the collected set is bounded.
    """
    wanted = F.col("protocol").isin(protocols)
    fail = F.when(wanted & (F.col("gate_failure_category") != "none"), F.col("gate_failure_category"))
    mine = lambda c: F.when(wanted, F.col(c))
    g = df.groupBy("model_name", "family_id", "seed").agg(
        F.array_join(F.array_sort(F.collect_set("protocol")), ",").alias("protocols_present"),
        (F.count_distinct(F.when(wanted, F.col("protocol"))) == len(set(protocols))).alias("has_all_protocols"),
        F.every(F.coalesce(mine("gate_pass"), F.lit(True))).alias("__pass"),
        F.array_join(F.array_sort(F.collect_set(fail)), ";").alias("__fail"),
        F.max(mine("attacked_benign_fpr")).alias("__a"),
        F.max(mine("clean_fpr")).alias("__c"),
        F.min(mine("adv_malicious_recall")).alias("__r"),
        F.avg(mine("clean_f1")).alias("__f"),
        F.avg(F.when(wanted, _finite("robust_f1"))).alias("__b"),
    )
    full = F.col("has_all_protocols")
    return g.select(
        candidate_key("model_name", "family_id", "seed").alias("candidate_key"),
        candidate_key("model_name", "family_id").alias("candidate_group_key"),
        "model_name",
        "family_id",
        "seed",
        "protocols_present",
        "has_all_protocols",
        (full & F.col("__pass")).alias("gate_pass"),
        F.when(~full, F.lit("missing_protocol_rows"))
        .when(F.col("__pass"), F.lit("none"))
        .otherwise(F.col("__fail"))
        .alias("gate_failure_category"),
        F.when(full, F.col("__a")).alias("worst_attacked_benign_fpr"),
        F.when(full, F.col("__c")).alias("worst_clean_fpr"),
        F.when(full, F.col("__r")).alias("worst_adv_malicious_recall"),
        F.when(full, F.col("__f")).alias("mean_clean_f1"),
        F.when(full, F.col("__b")).alias("mean_robust_f1"),
    )


def rank_global(df: DataFrame) -> DataFrame:
    renamed = {
        "attacked_benign_fpr": "worst_attacked_benign_fpr",
        "clean_fpr": "worst_clean_fpr",
        "adv_malicious_recall": "worst_adv_malicious_recall",
        "clean_f1": "mean_clean_f1",
        "robust_f1": "mean_robust_f1",
    }
    aliased = df.withColumns({k: F.col(v) for k, v in renamed.items()})
    return rank_candidates(aliased, by=[], tie=["candidate_key"]).drop(*renamed)


def shortlist(ranked: DataFrame, *, k: int, models: list[str], names: DataFrame | None = None) -> DataFrame:
    """The best row of every enabled model, then the best remaining groups up to max(k, number of models)."""
    enabled = ranked.where(F.lower(F.trim("model_name")).isin([m.lower() for m in models]))
    group = Window.partitionBy("candidate_group_key").orderBy("final_rank")
    once = enabled.withColumn("__g", F.row_number().over(group)).where(F.col("__g") == 1).drop("__g")
    lead = Window.partitionBy("model_name").orderBy("final_rank")
    once = once.withColumn("__lead", (F.row_number().over(lead) > 1).cast("int"))
    out = once.orderBy("__lead", "final_rank").limit(max(int(k), len(models), 1)).withColumnRenamed("__lead", "picked_by_rank")
    if names is not None:
        out = null_safe_join(out, names, ["family_id"], "left").withColumn(
            "family_name", F.coalesce("family_name", F.lit("unknown"))
        )
    return out


def stability_summary(coarse: DataFrame, stability: DataFrame) -> DataFrame:
    """A group is stable when its coarse run and every checked seed pass the gate."""
    first = coarse.groupBy("candidate_group_key").agg(F.some("gate_pass").alias("coarse_pass"))
    seeds = stability.groupBy("candidate_group_key").agg(
        F.every("global_gate_pass").alias("all_pass"),
        F.some("global_gate_pass").alias("any_pass"),
        F.count("*").alias("n"),
    )
    j = null_safe_join(seeds, first, ["candidate_group_key"], "left").fillna(False, ["coarse_pass"])
    return j.select(
        "candidate_group_key",
        (F.col("coarse_pass") & F.col("all_pass")).alias("consistent_gate_pass"),
        (F.col("coarse_pass") | F.col("any_pass")).alias("any_seed_pass"),
        (F.col("n") + 1).alias("num_seeds_checked"),
    )


def protocol_hard_cap(df: DataFrame) -> DataFrame:
    """Protocols for which no candidate has a single threshold that passes the gates."""
    return df.groupBy("protocol").agg((~F.some(F.coalesce(F.col("num_gate_pass"), F.lit(0)) > 0)).alias("hard_cap"))


def escalation(
    protocol_rows: DataFrame, global_rows: DataFrame, stability: DataFrame | None
) -> DataFrame:
    """One row: whether to escalate and the first matching reason."""
    one = F.lit(1).alias("one")
    p = protocol_hard_cap(protocol_rows).agg(F.some("hard_cap").alias("tuning_infeasible"), F.lit(1).alias("one"))
    cap = protocol_rows.agg(
        F.coalesce(F.some(F.col("gate_failure_category").contains("data_cap_infeasible")), F.lit(False)).alias("cap_p"),
        F.lit(1).alias("one"),
    )
    g = global_rows.agg(
        F.coalesce(F.some("gate_pass"), F.lit(False)).alias("any_global"),
        F.coalesce(F.some(F.col("gate_failure_category").contains("data_cap_infeasible")), F.lit(False)).alias("cap_g"),
        F.lit(1).alias("one"),
    )
    j = p.join(cap, "one").join(g, "one")
    if stability is None:
        j = j.withColumns({"stable": F.col("any_global"), "checked": F.lit(False)})
    else:
        s = stability_summary(global_rows, stability).agg(
            F.coalesce(F.some("consistent_gate_pass"), F.lit(False)).alias("stable"), (F.count("*") > 0).alias("checked")
        )
        j = j.join(s.select("*", one), "one")
    reason = (
        F.when(F.col("stable"), F.lit("none"))
        .when(F.col("cap_p") | F.col("cap_g"), F.lit("data_cap_infeasible"))
        .when(F.col("tuning_infeasible"), F.lit("tuning_infeasible"))
        .when(F.col("checked") & F.col("any_global"), F.lit("stability_infeasible"))
        .otherwise(F.lit("no_stable_candidate"))
    )
    return j.select((~F.col("stable")).alias("triggered"), reason.alias("reason"), "tuning_infeasible")


def weighted_objective(df: DataFrame, *, by: list[str], objective: str, weight: str, feasible: str) -> DataFrame:
    """Objective averaged over protocols by validation rows, and the share of feasible protocols."""
    return df.groupBy(*by).agg(
        ratio(F.sum(F.col(objective) * F.col(weight)), F.sum(weight)).alias("weighted_objective"),
        F.avg(F.col(feasible).cast("double")).alias("feasible_ratio"),
        F.count("*").alias("protocols"),
    )


def leaderboard(df: DataFrame, *, by: list[str], primary: str, tie: list[str]) -> DataFrame:
    """Best value of a measure first within each scope."""
    w = Window.partitionBy(*by).orderBy(_finite(primary).desc_nulls_last(), *[F.col(t) for t in tie])
    return df.withColumn("rank", F.row_number().over(w))
