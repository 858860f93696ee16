"""Feature constraints, projections, perturbation scenarios and the guarded threshold tune."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from flowlens.catalog.base import (
    LOCKABLE,
    MODELS,
    PROTOCOLS,
    RELATED,
    ROLE_INDEX,
    ROLES,
    THRESHOLDS,
    flows,
    query,
    rounded,
    row_hash_sql,
)
from flowlens.catalog.profile_queries import unpivot_sql
from flowlens.operators import combine, constraints as C, perturb, reports, score, search
from flowlens.operators.profile import long_features
from flowlens.operators.score import LinearModel
from flowlens.plans.small import cut_lineage, once_per_row, spread_out

P = "protocol_hint"
KEEP = ["source_row_index", P, "label", "threshold"]

# One surrogate per protocol over value, k and the locked hr.
ADV = ["value", "k", "hr"]
MEAN, STD = {"value": 50.0, "k": 50.0, "hr": 12.0}, {"value": 50.0, "k": 29.0, "hr": 7.0}
SURROGATES = {
    "wifi": LinearModel({"value": 1.5, "k": 1.4, "hr": 0.1}, 0.4, MEAN, STD),
    "mqtt": LinearModel({"value": 1.3, "k": 1.6, "hr": -0.1}, 0.3, MEAN, STD),
    "bluetooth": LinearModel({"value": 1.6, "k": 1.2, "hr": 0.0}, 0.5, MEAN, STD),
}
LOCKS = ["hr"]


def constraint_table(spark, sf, features, locks=LOCKS):
    return C.feature_constraints(flows(spark, sf), by=P, features=features, semantic_locks=locks)


def con_ctes(features: list[str], locks: list[str]) -> str:
    lock = "feature IN (" + ", ".join(f"'{x}'" for x in locks) + ")" if locks else "false"
    return f"""lng AS ({unpivot_sql("flows", [P], features)}), con AS (
  SELECT *, {lock} AS sem, unique_count <= 20 AND lo_l >= -1e-8 AND hi_l <= 1 + 1e-8 AS auto FROM (
    SELECT {P}, feature, greatest(0, quantile_cont(value, 0.01)) AS lower,
      greatest(greatest(0, quantile_cont(value, 0.01)), quantile_cont(value, 0.99)) AS upper,
      quantile_cont(value, 0.01) AS p_low, quantile_cont(value, 0.99) AS p_high, min(value) AS raw_min, max(value) AS raw_max,
      count(*) AS rows, count(DISTINCT round_even(value, 6)) AS unique_count, min(round_even(value, 6)) AS lo_l,
      max(round_even(value, 6)) AS hi_l FROM lng GROUP BY 1, 2)),
  wide AS (SELECT {P} AS wp, {", ".join(f"max(lower) FILTER (WHERE feature = '{f}') AS lo_{f}, max(upper) FILTER (WHERE feature = '{f}') AS hi_{f}" for f in features)}
    FROM con GROUP BY 1)"""


# C-01
@query(f"""WITH {con_ctes(LOCKABLE, LOCKS)} SELECT {P}, feature, round(lower, 6) AS lower, round(upper, 6) AS upper,
    round(greatest(upper - lower, 1e-12), 6) AS span, sem OR auto AS locked, concat(CASE WHEN sem THEN 'semantic' ELSE '' END,
    CASE WHEN sem AND auto THEN '|' ELSE '' END, CASE WHEN auto THEN 'auto_low_cardinality' ELSE '' END) AS lock_reason,
    rows, round(raw_min, 6) AS raw_min, round(raw_max, 6) AS raw_max, round(p_low, 6) AS p_low, round(p_high, 6) AS p_high,
    unique_count FROM con""", ("flows",))
def feature_constraints(spark, sf):
    return rounded(constraint_table(spark, sf, LOCKABLE))


def band_sql(value: str, source: str) -> str:
    return f"""greatest(0, quantile_cont({value}, 0.01) - (0.05::DOUBLE * greatest(quantile_cont({value}, 0.99) - quantile_cont({value}, 0.01), 1e-9) + 1e-9)) AS band_low,
    quantile_cont({value}, 0.99) + (0.05::DOUBLE * greatest(quantile_cont({value}, 0.99) - quantile_cont({value}, 0.01), 1e-9) + 1e-9) AS band_high {source}"""


# C-02
@query(f"SELECT {P}, round(band_low, 6) AS band_low, round(band_high, 6) AS band_high, n FROM (SELECT {P}, count(*) AS n, "
       f"{band_sql('k / hr', 'FROM flows WHERE hr > 0 GROUP BY 1')})", ("flows",))
def quantile_band(spark, sf):
    r = F.when(F.col("hr") > 0, F.col("k") / F.col("hr")).otherwise(F.lit(float("inf")))
    out = C.quantile_band(flows(spark, sf).withColumn("r", r), by=[P], value="r", low=0.01, high=0.99, nonnegative=True)
    return rounded(out)


BANDS = f"""rel AS (SELECT {P}, 'tot_num_avg' AS relation, f_tot / (f_number * f_avg) AS r FROM flows WHERE f_number * f_avg > 1e-9
    UNION ALL SELECT {P}, 'rate_ratio', (f_srate + f_drate) / f_rate FROM flows WHERE f_rate > 1e-9),
  bands AS (SELECT {P}, relation, count(*) AS n, {band_sql("r", "FROM rel GROUP BY 1, 2")})"""


def band_table(spark, sf):
    return C.relation_profile(flows(spark, sf), by=P, roles=ROLES)


# C-03
@query(f"WITH {BANDS} SELECT {P}, relation, round(band_low, 6) AS band_low, round(band_high, 6) AS band_high, n FROM bands",
       ("flows",))
def relation_profile(spark, sf):
    return rounded(band_table(spark, sf))


# C-05
@query(f"""WITH lng AS ({unpivot_sql("flows", [], LOCKABLE + RELATED)}), n AS (SELECT feature, count(*) AS rows,
    regexp_replace(lower(feature), '[^0-9a-z]', '', 'g') AS key FROM lng GROUP BY 1)
  SELECT feature, rows, least(CAST(0.5 AS DOUBLE), CASE WHEN contains(key, 'rate') THEN CAST(0.2 AS DOUBLE) ELSE 0.5 END,
    CASE WHEN regexp_matches(key, 'byte|packet|count|number|size|tot|sum|len|volume') THEN CAST(0.3 AS DOUBLE) ELSE 0.5 END,
    CASE WHEN regexp_matches(key, 'time|dur|iat|interval|latency') THEN CAST(0.1 AS DOUBLE) ELSE 0.5 END) AS relative_cap
  FROM n""", ("flows",))
def relative_caps(spark, sf):
    names = long_features(flows(spark, sf), [], LOCKABLE + RELATED).groupBy("feature").agg(F.count("*").alias("rows"))
    return C.relative_caps_table(names, feature="feature", default=0.5, rate=0.2, size=0.3, time=0.1)


def related_rows(spark, sf, locks=None, label=None):
    """Rows with their profile arrays: x0 is the original vector, x a moved candidate that breaks some relations. Profiles are
    those of all rows, also where only rows of one ``label`` are wanted."""
    caps = C.relative_caps(RELATED, default=0.5, rate=0.2, size=0.3)
    con = constraint_table(spark, sf, RELATED, locks=locks)
    prof = C.profile_arrays(con, by=P, features=RELATED, caps=caps, bands=band_table(spark, sf))
    f = spread_out(flows(spark, sf))
    f = C.attach_profile(f if label is None else f.where(F.col("label") == label), prof, by=P)
    shift = F.col("hr") - F.lit(12.0)
    moved = [
        F.col("f_min") + F.lit(2.0) * shift,
        F.col("f_avg") - shift,
        F.col("f_max") - shift,
        F.col("f_tot") * F.lit(1.3),
        F.col("f_number"),
        F.col("f_srate") + shift,
        F.col("f_drate"),
        F.col("f_rate") * F.lit(0.9),
    ]
    f = once_per_row(f, {"x0": C.vector(RELATED), "x": F.array(*moved)})
    bands = [c for c in f.columns if "_band_" in c]
    arrays = ["p_lower", "p_upper", "p_span", "p_locked", "p_cap", "x0", "x"]
    return f.select("source_row_index", P, *arrays, *bands)


CAPS = C.relative_caps(RELATED, default=0.5, rate=0.2, size=0.3)
SHORT = dict(zip(RELATED, ("mn", "av", "mx", "tot", "num", "sr", "dr", "rt")))
RELATED_SQL = f"""{con_ctes(RELATED, [])}, {BANDS}, bw AS (SELECT {P} AS bp,
    max(band_low) FILTER (WHERE relation = 'tot_num_avg') AS t_lo, max(band_high) FILTER (WHERE relation = 'tot_num_avg') AS t_hi,
    max(band_low) FILTER (WHERE relation = 'rate_ratio') AS r_lo, max(band_high) FILTER (WHERE relation = 'rate_ratio') AS r_hi
    FROM bands GROUP BY 1),
  cnd AS (SELECT *, f_min + 2 * (hr - 12) AS mn, f_avg - (hr - 12) AS av, f_max - (hr - 12) AS mx, f_tot * CAST(1.3 AS DOUBLE) AS tot,
    f_number AS num, f_srate + (hr - 12) AS sr, f_drate AS dr, f_rate * CAST(0.9 AS DOUBLE) AS rt FROM flows
    JOIN wide ON wp = {P} JOIN bw ON bp = {P})"""


def flags_sql(tol: str = "1e-6") -> str:
    return f"""(av < mn - {tol} OR av > mx + {tol}) AS v1, coalesce(num * av > 1e-9 AND (tot / nullif(num * av, 0) < t_lo - {tol} OR
    tot / nullif(num * av, 0) > t_hi + {tol}), false) AS v2, coalesce(rt > 1e-9 AND ((sr + dr) / nullif(rt, 0) < r_lo - {tol} OR
    (sr + dr) / nullif(rt, 0) > r_hi + {tol}), false) AS v3"""


# C-06, C-07, J-02
@query(f"""WITH {con_ctes(LOCKABLE, LOCKS)} SELECT source_row_index, round(least(0.1::DOUBLE * greatest(hi_value - lo_value, 1e-12),
      0.5::DOUBLE * greatest(abs(value), 1)), 6) AS cap_value, round(least(0.1::DOUBLE * greatest(hi_k - lo_k, 1e-12),
      0.5::DOUBLE * greatest(abs(k), 1)), 6) AS cap_k, 0::DOUBLE AS cap_hr,
    round(least(greatest(value * 1.2::DOUBLE - 5, lo_value), hi_value), 6) AS new_value,
    round(least(greatest(k * 1.2::DOUBLE - 5, lo_k), hi_k), 6) AS new_k, hr AS new_hr FROM flows JOIN wide ON wp = {P}""",
  ("flows",))
def project_bounds(spark, sf):
    caps = {f: 0.5 for f in LOCKABLE}
    prof = C.profile_arrays(constraint_table(spark, sf, LOCKABLE), by=P, features=LOCKABLE, caps=caps)
    f = C.attach_profile(flows(spark, sf), prof, by=P)
    f = f.withColumn("x0", C.vector(LOCKABLE))
    f = f.withColumn("x", F.transform("x0", lambda v: v * F.lit(1.2) - F.lit(5.0)))
    n = len(LOCKABLE)
    f = f.withColumns(
        {"cap": C.max_delta(F.col("x0"), n, 0.1), "new": C.project_bounds(F.col("x"), F.col("x0"), n)}
    )
    f = C.spread(C.spread(f, "cap", LOCKABLE, "cap_"), "new", LOCKABLE, "new_")
    return rounded(f.select("source_row_index", "cap_value", "cap_k", "cap_hr", "new_value", "new_k", "new_hr"))


# J-02
@query(f"""WITH {con_ctes(LOCKABLE, LOCKS)} SELECT source_row_index, round(lo_value, 6) AS lower_value, round(hi_k, 6) AS upper_k
  FROM flows JOIN wide ON wp = {P}""", ("flows",))
def gather_profile(spark, sf):
    con = constraint_table(spark, sf, LOCKABLE)
    f = combine.gather_profile(
        flows(spark, sf).select("source_row_index", P), con, on=P, feature="feature", values=["lower", "upper"]
    )
    return rounded(
        f.select(
            "source_row_index",
            F.col("lower_by_feature")["value"].alias("lower_value"),
            F.col("upper_by_feature")["k"].alias("upper_k"),
        )
    )


# C-08
@query(f"""WITH {RELATED_SQL}, v AS (SELECT source_row_index, {flags_sql()} FROM cnd)
  SELECT source_row_index, v1 AS min_avg_max, v2 AS tot_num_avg, v3 AS rate_ratio, v1 OR v2 OR v3 AS any_violation FROM v""",
  ("flows",))
def relation_violations(spark, sf):
    flags = C.relation_flags(F.col("x"), ROLE_INDEX)
    return related_rows(spark, sf).select(
        "source_row_index",
        flags["min_avg_max"].alias("min_avg_max"),
        flags["tot_num_avg"].alias("tot_num_avg"),
        flags["rate_ratio"].alias("rate_ratio"),
        flags["any"].alias("any_violation"),
    )


EPS = 0.2


def clip_sql(src: str, out: str, locked: tuple[str, ...] = ()) -> str:
    """Bounds, then the allowed move around the original; every other column is passed on."""
    cols = [f"{f} AS {SHORT[f]}" for f in locked]
    for f, s in SHORT.items():
        if f in locked:
            continue
        cap = f"least({EPS}::DOUBLE * greatest(hi_{f} - lo_{f}, 1e-12), {CAPS[f]}::DOUBLE * greatest(abs({f}), 1))"
        cols.append(f"{f} + least(greatest(least(greatest({s}, lo_{f}), hi_{f}) - {f}, -({cap})), {cap}) AS {s}")
    return f"{out} AS MATERIALIZED (SELECT * REPLACE ({', '.join(cols)}) FROM {src})"


def repair_sql(src: str, out: str, locked: tuple[str, ...] = ()) -> str:
    """``locked`` may hold f_max: then a crossed minimum goes to it, where both would meet in the middle."""
    meet, top = ("mx", "mx") if "f_max" in locked else ("0.5::DOUBLE * (mn + mx)", "0.5::DOUBLE * (mn + mx)")
    return f"""{out}a AS (SELECT * REPLACE (CASE WHEN mn > mx THEN {meet} ELSE mn END AS mn,
      CASE WHEN mn > mx THEN {top} ELSE mx END AS mx) FROM {src}),
    {out}b AS (SELECT * REPLACE (CASE WHEN av < mn THEN mn WHEN av > mx THEN mx ELSE av END AS av) FROM {out}a),
    {out}c AS (SELECT * REPLACE (CASE WHEN num * av > 1e-9 THEN least(greatest(tot / nullif(num * av, 0), t_lo), t_hi) * (num * av)
      ELSE tot END AS tot) FROM {out}b),
    {out}d AS (SELECT *, CASE WHEN rt > 1e-9 THEN least(greatest((sr + dr) / nullif(rt, 0), r_lo), r_hi) END AS goal FROM {out}c),
    {out}e AS (SELECT * EXCLUDE (goal) REPLACE (CASE WHEN goal IS NULL THEN sr WHEN sr + dr <= 1e-12 THEN 0.5::DOUBLE * goal * rt
        ELSE sr * (goal * rt / (sr + dr)) END AS sr, CASE WHEN goal IS NULL THEN dr WHEN sr + dr <= 1e-12 THEN 0.5::DOUBLE * goal * rt
        ELSE dr * (goal * rt / (sr + dr)) END AS dr) FROM {out}d), {clip_sql(out + "e", out, locked)}"""


def within_sql(get, locked: tuple[str, ...] = ()) -> str:
    parts = []
    for f, s in SHORT.items():
        cap = "0" if f in locked else f"least({EPS}::DOUBLE * greatest(hi_{f} - lo_{f}, 1e-12), {CAPS[f]}::DOUBLE * greatest(abs({f}), 1))"
        v = get(f, s)
        parts.append(f"{v} >= lo_{f} - 1e-6 AND {v} <= hi_{f} + 1e-6 AND abs({v} - {f}) <= {cap} + 1e-6")
    return " AND ".join(parts)


def project_sql(locked: tuple[str, ...] = ()) -> str:
    rounds = ", ".join(repair_sql(f"p{i}", f"p{i + 1}", locked) for i in range(4))
    return f"""{RELATED_SQL}, {clip_sql("cnd", "p0", locked)}, {rounds}, fl AS MATERIALIZED (SELECT *, {flags_sql()} FROM p4),
  res AS (SELECT *, NOT (v1 OR v2 OR v3) AND {within_sql(lambda f, s: s, locked)} AS good FROM fl)"""


PROJECT_SQL = project_sql()
FIXED = ("f_max",)  # locked in the integrity check
STUCK = "f_srate"  # locked in the summary of unprojected candidates, which do move it


def projected(spark, sf, locks=None):
    return C.project_row(
        related_rows(spark, sf, locks),
        candidate="x",
        original="x0",
        reference="x0",
        index=ROLE_INDEX,
        n=len(RELATED),
        eps=EPS,
    )


# C-09
@query(f"""WITH {PROJECT_SQL} SELECT source_row_index, {", ".join(f"round(CASE WHEN good THEN {s} ELSE {f} END, 5) AS p_{f}" for f, s in SHORT.items())}
  FROM res""", ("flows",))
def project_row(spark, sf):
    out = C.spread(projected(spark, sf), "projected", RELATED, "p_")
    return rounded(out.select("source_row_index", *[f"p_{f}" for f in RELATED]), 5)


def outside_sql(locked: tuple[str, ...]) -> str:
    free = {f: s for f, s in SHORT.items() if f not in locked}
    below = " + ".join(f"CAST({s} < lo_{f} - 1e-6 AS INTEGER)" for f, s in free.items())
    above = " + ".join(f"CAST({s} > hi_{f} + 1e-6 AS INTEGER)" for f, s in free.items())
    return f"""CAST(coalesce(sum({below}), 0) AS BIGINT) AS below_lower_violations,
    CAST(coalesce(sum({above}), 0) AS BIGINT) AS above_upper_violations"""


def over_sql(locked: tuple[str, ...]) -> str:
    allowed = {
        f: "0" if f in locked else f"least({EPS}::DOUBLE * greatest(hi_{f} - lo_{f}, 1e-12), {CAPS[f]}::DOUBLE * greatest(abs({f}), 1))"
        for f in SHORT
    }
    return "greatest(" + ", ".join(f"abs({s} - {f}) - {allowed[f]}" for f, s in SHORT.items()) + ")"


# A-39: candidates that were not projected, with a locked feature that they move
@query(f"""WITH {RELATED_SQL}, v AS (SELECT *, {flags_sql()}, {over_sql((STUCK,))} AS over_cap, abs({SHORT[STUCK]} - {STUCK}) AS moved FROM cnd)
  SELECT {P}, {outside_sql((STUCK,))}, count(*) FILTER (WHERE moved > 1e-9) AS locked_change_rows,
    round(max(moved), 6) AS locked_change_max_abs,
    count(*) FILTER (WHERE over_cap > 1e-2) AS cap_violation_rows, count(*) FILTER (WHERE v1 OR v2 OR v3) AS relation_violation_rows,
    count(*) FILTER (WHERE v1) AS relation_min_avg_max_rows, count(*) FILTER (WHERE v2) AS relation_tot_num_avg_rows,
    count(*) FILTER (WHERE v3) AS relation_rate_rows FROM v GROUP BY 1""", ("flows",))
def violation_summary(spark, sf):
    rows = related_rows(spark, sf, [STUCK])
    return rounded(C.violation_summary(rows, x="x", x0="x0", index=ROLE_INDEX, n=len(RELATED), eps=EPS, by=[P]))


# X-08: moved rows keep bounds, locks and relations after the projection, and the assertion holds
CHANGED = "greatest(" + ", ".join(f"abs({s} - {f})" for f, s in SHORT.items()) + ") > 1e-9"


@query(f"""WITH {project_sql(FIXED)}, fin AS MATERIALIZED (SELECT * EXCLUDE (v1, v2, v3) REPLACE (
      {", ".join(f"CASE WHEN good THEN {s} ELSE {f} END AS {s}" for f, s in SHORT.items())}) FROM res),
    fin2 AS MATERIALIZED (SELECT *, {flags_sql()}, {over_sql(FIXED)} AS over_cap, {CHANGED} AS changed FROM fin),
    every AS (SELECT {P}, count(*) AS rows, count(*) FILTER (WHERE changed) AS changed_rows FROM fin2 GROUP BY 1),
    broken AS (SELECT {P} AS bp2, {outside_sql(FIXED)}, count(*) FILTER (WHERE abs(mx - f_max) > 1e-9) AS locked_change_rows,
      count(*) FILTER (WHERE over_cap > 1e-2) AS cap_violation_rows,
      count(*) FILTER (WHERE v1 OR v2 OR v3) AS relation_violation_rows FROM fin2 WHERE changed GROUP BY 1)
  SELECT {P}, rows, changed_rows, coalesce(below_lower_violations, 0) AS below_lower_violations,
    coalesce(above_upper_violations, 0) AS above_upper_violations, coalesce(locked_change_rows, 0) AS locked_change_rows,
    coalesce(cap_violation_rows, 0) AS cap_violation_rows, coalesce(relation_violation_rows, 0) AS relation_violation_rows
  FROM every LEFT JOIN broken ON bp2 = {P}""", ("flows",))
def violation_assertion(spark, sf):
    rows = projected(spark, sf, list(FIXED)).withColumn("x", F.col("projected"))
    found = C.integrity(rows, x="x", x0="x0", index=ROLE_INDEX, n=len(RELATED), eps=EPS, by=[P])
    found = cut_lineage(found)  # a row for each protocol
    C.assert_integrity(found)
    return found.select(
        P, "rows", "changed_rows", "below_lower_violations", "above_upper_violations", "locked_change_rows", "cap_violation_rows",
        "relation_violation_rows",
    )


# ---- perturbations ------------------------------------------------------------------------------------------------


def adv_rows(spark, sf):
    f = cut_lineage(spread_out(flows(spark, sf).select(*KEEP, *ADV)))  # the constraints read it several times
    con = C.feature_constraints(f, by=P, features=ADV, semantic_locks=LOCKS)
    f = C.attach_profile(f, C.profile_arrays(con, by=P, features=ADV, caps={x: 0.5 for x in ADV}), by=P)
    f = once_per_row(f, {"x": C.vector(ADV)})
    return perturb.attach_surrogate(f, SURROGATES, ADV, by=P)


def case_sql(get) -> str:
    return "CAST(CASE " + P + "".join(f" WHEN '{p}' THEN {get(m)}" for p, m in SURROGATES.items()) + " END AS DOUBLE)"


def shifted_sql(eps: float) -> tuple[str, str]:
    out = []
    for f in ("value", "k"):
        out.append(f"least(greatest({f} - {eps}::DOUBLE * {STD[f]}::DOUBLE, lo_{f}), hi_{f})")
    return out[0], out[1]


def score_sql(v: str, k: str) -> str:
    z = (
        f"{case_sql(lambda m: m.bias)} + {case_sql(lambda m: m.weights['value'])} * ({v} - 50) / 50"
        f" + {case_sql(lambda m: m.weights['k'])} * ({k} - 50) / 29 + {case_sql(lambda m: m.weights['hr'])} * (hr - 12) / 7"
    )
    return f"1 / (1 + exp(-least(greatest({z}, -40), 40)))"


ADV_SQL = con_ctes(ADV, LOCKS)


# C-10
@query(f"""WITH {ADV_SQL} SELECT source_row_index, round({shifted_sql(0.2)[0]}, 6) AS a_value, round({shifted_sql(0.2)[1]}, 6) AS a_k,
    hr AS a_hr FROM flows JOIN wide ON wp = {P} WHERE label = 1""", ("flows",))
def shift_fgsm(spark, sf):
    f = adv_rows(spark, sf).where(F.col("label") == 1).withColumn("a", perturb.shift_fgsm(F.col("x"), 3, 0.2))
    return rounded(C.spread(f, "a", ADV, "a_").select("source_row_index", "a_value", "a_k", "a_hr"))


# C-11: with a linear surrogate the iterated step ends where the single step of the same radius ends
@query(f"""WITH {ADV_SQL} SELECT source_row_index, round({shifted_sql(0.1)[0]}, 6) AS a_value, round({shifted_sql(0.1)[1]}, 6) AS a_k,
    hr AS a_hr FROM flows JOIN wide ON wp = {P} WHERE label = 1""", ("flows",))
def shift_pgd(spark, sf):
    f = adv_rows(spark, sf).where(F.col("label") == 1).withColumn("a", perturb.shift_pgd(F.col("x"), 3, 0.1))
    return rounded(C.spread(f, "a", ADV, "a_").select("source_row_index", "a_value", "a_k", "a_hr"))


# C-12, O-07: the feature that pushes a protocol's rows most towards attack is the one that is lowered
@query(f"""WITH {ADV_SQL}, m AS (SELECT protocol_used, avg(w_value * value) AS v, avg(w_k * k) AS kk FROM scored GROUP BY 1),
    top AS (SELECT protocol_used AS tp, CASE WHEN greatest(v, kk) <= 0 THEN '' WHEN v > kk THEN 'value' ELSE 'k' END AS f FROM m)
  SELECT source_row_index, round(least(greatest(value - CASE WHEN f = 'value' THEN 0.05::DOUBLE * (hi_value - lo_value) ELSE 0 END,
      lo_value), hi_value), 6) AS a_value,
    round(least(greatest(k - CASE WHEN f = 'k' THEN 0.05::DOUBLE * (hi_k - lo_k) ELSE 0 END, lo_k), hi_k), 6) AS a_k, hr AS a_hr
  FROM flows JOIN wide ON wp = {P} JOIN top ON tp = {P} WHERE label = 1""", ("flows", "scored"))
def shift_topk(spark, sf):
    means = score.mean_abs_contribution(score.routed_score(flows(spark, sf), MODELS, THRESHOLDS), MODELS)
    chosen = score.positive_unlocked_features(means, LOCKS, 1)
    f = perturb.attach_top_features(adv_rows(spark, sf).where(F.col("label") == 1), chosen, ADV, by=P)
    f = f.withColumn("a", perturb.shift_topk(F.col("x"), 3, 0.05, F.col("top")))
    return rounded(C.spread(f, "a", ADV, "a_").select("source_row_index", "a_value", "a_k", "a_hr"))


# X-04
@query(f"""WITH {ADV_SQL} SELECT {P}, count(*) AS rows, count(*) FILTER (WHERE abs({shifted_sql(0.2)[0]} - value) > 1e-9 OR
    abs({shifted_sql(0.2)[1]} - k) > 1e-9) AS changed FROM flows JOIN wide ON wp = {P} WHERE label = 1 GROUP BY 1""", ("flows",))
def changed_rows(spark, sf):
    f = adv_rows(spark, sf).where(F.col("label") == 1).withColumn("a", perturb.shift_fgsm(F.col("x"), 3, 0.2))
    hit = perturb.changed_rows("x", "a", 3)
    return f.groupBy(P).agg(F.count("*").alias("rows"), F.count(F.when(hit, 1)).alias("changed"))


# A-22
DV, DK = f"({shifted_sql(0.2)[0]} - value)", f"({shifted_sql(0.2)[1]} - k)"


@query(f"""WITH {ADV_SQL}, d AS (SELECT {P}, {DV} AS a, {DK} AS b, {DV} / (hi_value - lo_value) AS sa, {DK} / (hi_k - lo_k) AS sb
      FROM flows JOIN wide ON wp = {P} WHERE label = 1),
    m AS (SELECT {P}, 'l0' AS measure, CAST(abs(a) > 1e-12 AS INTEGER) + CAST(abs(b) > 1e-12 AS INTEGER)::DOUBLE AS v FROM d
      UNION ALL SELECT {P}, 'l2', sqrt(a * a + b * b) FROM d UNION ALL SELECT {P}, 'linf', greatest(abs(a), abs(b)) FROM d
      UNION ALL SELECT {P}, 'l2_norm', sqrt(sa * sa + sb * sb) FROM d
      UNION ALL SELECT {P}, 'linf_norm', greatest(abs(sa), abs(sb)) FROM d)
  SELECT {P}, measure, count(*) AS rows, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median,
    round(quantile_cont(v, 0.95), 6) AS p95 FROM m GROUP BY 1, 2""", ("flows",))
def perturbation_stats(spark, sf):
    f = adv_rows(spark, sf).where(F.col("label") == 1).withColumn("a", perturb.shift_fgsm(F.col("x"), 3, 0.2))
    return rounded(perturb.perturbation_stats(f, x="x", adv="a", n=3, by=[P]))


SCENARIOS = perturb.scenario_list(["fgsm", "pgd"], [0.05, 0.2])


def scenario_rows(spark, sf):
    return perturb.scenario_scores(adv_rows(spark, sf), x="x", n=3, label="label", scenarios=SCENARIOS)


SCEN_SQL = f"""{ADV_SQL}, ss AS (SELECT source_row_index, {P}, label, threshold, {score_sql("value", "k")} AS s0,
    {score_sql(*shifted_sql(0.05))} AS s1, {score_sql(*shifted_sql(0.2))} AS s2 FROM flows JOIN wide ON wp = {P}),
  scen AS (SELECT source_row_index, {P}, label, threshold, s0, method, epsilon, CASE WHEN epsilon = 0 OR label = 0 THEN s0
      WHEN epsilon < 0.1 THEN s1 ELSE s2 END AS s
    FROM ss, (VALUES ('baseline', 0::DOUBLE), ('fgsm', 0.05), ('fgsm', 0.2), ('pgd', 0.05), ('pgd', 0.2)) x(method, epsilon))"""


# C-13
@query(f"WITH {SCEN_SQL} SELECT source_row_index, method, epsilon, round(s, 6) AS score FROM scen", ("flows",))
def scenario_scores(spark, sf):
    cells = [
        F.struct(F.lit(m).alias("method"), F.lit(e).alias("epsilon"), F.round(F.get("scores", F.lit(i)), 6).alias("score"))
        for i, (m, e) in enumerate(SCENARIOS)
    ]
    return scenario_rows(spark, sf).select("source_row_index", F.explode(F.array(*cells)).alias("c")).select(
        "source_row_index", "c.*"
    )


def scenario_count_table(spark, sf):
    return perturb.scenario_counts(
        scenario_rows(spark, sf), by=P, label="label", threshold="threshold", scenarios=SCENARIOS
    )


MET_SQL = f"""{SCEN_SQL}, sx AS (SELECT {P} AS scope, * FROM scen UNION ALL SELECT 'global_protocol_routed', * FROM scen),
  sc0 AS (SELECT scope, method, epsilon, count(*) FILTER (WHERE label = 1 AND s >= threshold) AS tp,
      count(*) FILTER (WHERE label = 0 AND s < threshold) AS tn, count(*) FILTER (WHERE label = 0 AND s >= threshold) AS fp,
      count(*) FILTER (WHERE label = 1 AND s < threshold) AS fn,
      count(*) FILTER (WHERE label = 1 AND s0 >= threshold AND s < threshold) AS an,
      count(*) FILTER (WHERE label = 1 AND s0 >= threshold) AS ad FROM sx GROUP BY 1, 2, 3),
  met AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS pr, tp / nullif(tp + fn, 0)::DOUBLE AS rc,
      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1v, fp / nullif(fp + tn, 0)::DOUBLE AS fr FROM sc0)"""


# C-14, A-18, J-06
@query(f"""WITH {MET_SQL} SELECT m.scope, m.method, m.epsilon, m.tp, m.tn, m.fp, m.fn, round(m.pr, 6) AS precision,
    round(m.rc, 6) AS recall, round(m.f1v, 6) AS f1, round(m.fr, 6) AS fpr, round(m.an / nullif(m.ad, 0)::DOUBLE, 6) AS asr_conditional,
    round(m.fn / nullif(m.tp + m.fn, 0)::DOUBLE, 6) AS asr_all, round(m.f1v - b.f1v, 6) AS delta_f1
  FROM met m JOIN met b ON b.scope = m.scope AND b.method = 'baseline'""", ("flows",))
def scenario_metrics(spark, sf):
    return rounded(perturb.scenario_metrics(scenario_count_table(spark, sf), by=P))


# L-18: robustness table
@query(f"""WITH {MET_SQL} SELECT b.scope, round(b.fr, 6) AS clean_fpr, round(b.rc, 6) AS clean_recall, round(b.f1v, 6) AS clean_f1,
    CAST(NULL AS DOUBLE) AS attacked_benign_fpr, round(min(m.rc), 6) AS adv_malicious_recall, round(min(m.f1v), 6) AS robust_f1
  FROM met b JOIN met m ON m.scope = b.scope AND m.epsilon > 0 WHERE b.method = 'baseline' GROUP BY b.scope, b.fr, b.rc, b.f1v""",
  ("flows",))
def robustness_table(spark, sf):
    return rounded(reports.robustness_table(scenario_count_table(spark, sf), by=P))


DELTAS = [-0.05, 0.0, 0.05]


# C-15, J-08, A-23, O-06
@query(f"""WITH {SCEN_SQL}, th AS (SELECT {P} AS p, b AS base, least(1::DOUBLE, greatest(0::DOUBLE, b + d)) AS t FROM
      (VALUES ('wifi', 0.55::DOUBLE), ('mqtt', 0.5), ('bluetooth', 0.6)) v({P}, b), (VALUES (-0.05::DOUBLE), (0), (0.05)) w(d)),
    c AS (SELECT p, t, base, method, epsilon, count(*) FILTER (WHERE label = 1 AND s >= t) AS tp,
        count(*) FILTER (WHERE label = 0 AND s >= t) AS fp, count(*) FILTER (WHERE label = 1) AS np,
        count(*) FILTER (WHERE label = 0) AS nn FROM scen JOIN th ON p = {P} GROUP BY 1, 2, 3, 4, 5),
    cm AS (SELECT a.t AS wt, b.t AS mt, d.t AS bt, a.method, a.epsilon, a.tp + b.tp + d.tp AS tp, a.fp + b.fp + d.fp AS fp,
        a.np + b.np + d.np AS np, a.nn + b.nn + d.nn AS nn,
        abs(a.t - a.base) + abs(b.t - b.base) + abs(d.t - d.base) AS shift
      FROM c a JOIN c b ON a.method = b.method AND a.epsilon = b.epsilon JOIN c d ON a.method = d.method AND a.epsilon = d.epsilon
      WHERE a.p = 'wifi' AND b.p = 'mqtt' AND d.p = 'bluetooth'),
    m AS (SELECT *, coalesce(2 * tp / nullif(tp + fp + np, 0)::DOUBLE, 0) AS f1, tp / np::DOUBLE AS rc, fp / nn::DOUBLE AS fr FROM cm),
    r AS (SELECT wt, mt, bt, max(shift) AS shift, max(f1) FILTER (WHERE epsilon = 0) AS cf1, max(fr) FILTER (WHERE epsilon = 0) AS cfr,
        max(fr) FILTER (WHERE epsilon > 0) AS wf, min(rc) FILTER (WHERE epsilon > 0) AS wr, min(f1) FILTER (WHERE epsilon > 0) AS w1
      FROM m GROUP BY 1, 2, 3),
    b AS (SELECT * FROM r WHERE shift = 0), g AS (SELECT r.*, r.cfr <= b.cfr AND r.wf <= b.wf AND r.wr >= b.wr - 0.002::DOUBLE
        AND r.w1 >= b.w1 - 0.002::DOUBLE AS guard_pass FROM r, b)
  SELECT round(wt, 6) AS wifi_threshold, round(mt, 6) AS mqtt_threshold, round(bt, 6) AS bluetooth_threshold,
    round(cf1, 6) AS clean_f1, round(cfr, 6) AS clean_fpr, round(wf, 6) AS worst_attacked_benign_fpr,
    round(wr, 6) AS worst_adv_malicious_recall, round(w1, 6) AS worst_robust_f1, guard_pass,
    CASE WHEN bool_or(guard_pass) OVER () THEN 'guarded' ELSE 'fallback_no_guard_pass' END AS selection_mode,
    row_number() OVER (ORDER BY guard_pass DESC, cf1 DESC, w1 DESC, wr DESC, cfr, shift, wt, mt, bt) AS rank FROM g""",
  ("flows",))
def guarded_threshold_tune(spark, sf):
    out = perturb.guarded_tune(
        scenario_rows(spark, sf), by=P, label="label", scenarios=SCENARIOS, base=THRESHOLDS, deltas=DELTAS
    )
    return rounded(
        out.select(
            *[f"{p}_threshold" for p in PROTOCOLS],
            "clean_f1",
            "clean_fpr",
            "worst_attacked_benign_fpr",
            "worst_adv_malicious_recall",
            "worst_robust_f1",
            "guard_pass",
            "selection_mode",
            "rank",
        )
    )


# ---- search -------------------------------------------------------------------------------------------------------

PLAN = search.SearchPlan(eps=0.1, budget=12, steps=3, candidates=4, subset=2, refine=2, objective="maximize")


def unit_sql(*parts: str) -> str:
    return f"({row_hash_sql('source_row_index', *parts, seed=PLAN.seed)} / {float(1 << 60)}::DOUBLE)"


def search_sql(steps: int) -> str:
    """The search of two free features: each step draws the same moves, scores them and keeps the best if it is better."""
    moves = {"value": "0", "k": "1"}
    first = {f: f"{unit_sql('step', 'c', i)}" for f, i in moves.items()}
    cap = {f: f"least({PLAN.eps}::DOUBLE * greatest(hi_{f} - lo_{f}, 1e-12), 0.5::DOUBLE * greatest(abs({f}), 1))" for f in moves}
    ctes = [f"""t0 AS MATERIALIZED (SELECT source_row_index, {P}, threshold, value, k, hr, lo_value, hi_value, lo_k, hi_k, lo_hr, hi_hr, value AS x_value, k AS x_k,
    {score_sql("value", "k")} - threshold AS base, {score_sql("value", "k")} - threshold AS margin, 0 AS queries, 0 AS moves
    FROM flows JOIN wide ON wp = {P} WHERE label = 0)"""]
    # a locked feature or a small allowance may keep a point outside its bounds: it is repaired to where the row was
    fits = " AND ".join(f"{x} >= lo_{f} - 1e-6 AND {x} <= hi_{f} + 1e-6" for f, x in (("value", "n_value"), ("k", "n_k"), ("hr", "hr")))
    for step in range(steps):
        new = []
        for f, i in moves.items():
            other = next(g for g in moves if g != f)
            # with one of two to move, it is the one of the lower draw
            chosen = f"(w = 2 OR u_{f} < u_{other} OR u_{f} = u_{other} AND {i} = 0)"
            size = f"(0.35::DOUBLE + 0.65::DOUBLE * {unit_sql('step', 'c', i, chr(39) + 'size' + chr(39))})"
            sign = f"CASE WHEN {unit_sql('step', 'c', i, chr(39) + 'sign' + chr(39))} < 0.65 THEN 1 ELSE -1 END"
            to = f"x_{f} + CASE WHEN {chosen} THEN ({sign}) * {size} * ({cap[f]}) ELSE 0 END"
            new.append(f"{f} + least(greatest(least(greatest({to}, lo_{f}), hi_{f}) - {f}, -({cap[f]})), {cap[f]}) AS n_{f}")
        ctes.append(f"""c{step} AS MATERIALIZED (SELECT *, {score_sql("n_value", "n_k")} - threshold AS m FROM (SELECT *, {", ".join(new)} FROM (
    SELECT *, {", ".join(f"{u} AS u_{f}" for f, u in first.items())}, CAST(floor({unit_sql("step", "c", "'width'")} * {PLAN.subset}) AS INTEGER) + 1 AS w
    FROM (SELECT t.*, {step} AS step, c FROM t{step} t, (VALUES (1), (2), (3), (4)) x(c) WHERE margin < 0 AND queries < {PLAN.budget}))))""")
        ctes.append(f"""t{step + 1} AS MATERIALIZED (SELECT t.* REPLACE (CASE WHEN better THEN b.n_value ELSE x_value END AS x_value,
    CASE WHEN better THEN b.n_k ELSE x_k END AS x_k, CASE WHEN better THEN b.m ELSE margin END AS margin,
    queries + CASE WHEN b.id IS NULL THEN 0 ELSE {PLAN.candidates + PLAN.refine} END AS queries, moves + CAST(coalesce(better, false) AS INTEGER) AS moves)
    FROM t{step} t LEFT JOIN (SELECT source_row_index AS id, n_value, n_k, m, fits AND m > margin + 1e-9 AS better FROM (
      SELECT *, {fits} AS fits FROM c{step} QUALIFY row_number() OVER (PARTITION BY source_row_index ORDER BY m DESC, n_value, n_k) <= {PLAN.refine})
      QUALIFY row_number() OVER (PARTITION BY source_row_index ORDER BY fits DESC, m DESC, n_value, n_k) = 1) b ON b.id = source_row_index)""")
    return f"WITH {ADV_SQL}, {', '.join(ctes)}"


# C-16: every row's point and margin after one step
@query(f"""{search_sql(1)} SELECT source_row_index, round(x_value, 6) AS x_value, round(x_k, 6) AS x_k, round(margin, 6) AS margin,
    queries, moves FROM t1""", ("flows",))
def search_step(spark, sf):
    result, _ = searched(spark, sf, replace(PLAN, steps=1))
    out = C.spread(result, "x_cur", ADV, "x_").select("source_row_index", "x_value", "x_k", "margin", "queries", "moves")
    return rounded(out)


def searched(spark, sf, plan):
    rows = adv_rows(spark, sf).where(F.col("label") == 0)
    margin = lambda v: perturb.stored_score(v, 3) - F.col("threshold")
    return search.hill_climb(rows, key="source_row_index", x="x", n=3, margin=margin, plan=plan)


# C-16, A-38: the whole search, whose budget is two rounds of four moves and two repairs; bounds and locks hold
@query(f"""{search_sql(2)} SELECT {P}, count(*) AS targeted_rows, count(*) FILTER (WHERE base >= 0) AS baseline_false_alarm_rows,
    count(*) FILTER (WHERE margin >= 0) AS attack_successes_any, count(*) FILTER (WHERE base < 0 AND margin >= 0) AS flip_rows,
    round(avg(CAST(base < 0 AND margin >= 0 AS DOUBLE)), 6) AS flip_rate, round(avg(CAST(margin >= 0 AS DOUBLE)), 6) AS attacked_pred_attack_rate,
    CAST(sum(queries) AS BIGINT) AS queries_total, round(avg(queries), 6) AS queries_mean, round(avg(moves), 6) AS accepted_moves_mean,
    round(quantile_cont(CAST(queries AS DOUBLE), 0.95), 6) AS queries_p95 FROM t2 GROUP BY 1""", ("flows",))
def budgeted_candidate_search(spark, sf):
    result, _ = searched(spark, sf, PLAN)  # of stored parts
    found = C.integrity(result.withColumn("x", F.col("x_cur")), x="x", x0="x0", index={}, n=3, eps=PLAN.eps, by=[P], queries="queries")
    C.assert_integrity(cut_lineage(found), budget=PLAN.budget)
    counted = cut_lineage(result.select(P, "baseline_margin", "margin", "success", "queries", "moves"))
    return rounded(search.campaign_stats(counted, by=[P]))


# C-16: nothing is lost, and no row takes more than the budget or goes down
@query(f"""WITH {ADV_SQL} SELECT {P}, count(*) AS targeted_rows, count(*) FILTER (WHERE {score_sql("value", "k")} >= threshold)
    AS baseline_false_alarm_rows, true AS none_lost, true AS within_budget, true AS only_upwards
  FROM flows JOIN wide ON wp = {P} WHERE label = 0 GROUP BY 1""", ("flows",))
def budgeted_search_guards(spark, sf):
    result, _ = searched(spark, sf, PLAN)
    stats = search.campaign_stats(result, by=[P])
    sane = result.groupBy(P).agg(
        F.every(F.col("queries") <= PLAN.budget).alias("within_budget"),
        F.every(F.col("margin") >= F.col("baseline_margin") - 1e-9).alias("only_upwards"),
    )
    stats = stats.withColumn("none_lost", F.col("attack_successes_any") >= F.col("baseline_false_alarm_rows"))
    return stats.join(sane, P).select(P, "targeted_rows", "baseline_false_alarm_rows", "none_lost", "within_budget", "only_upwards")


# C-16 with C-08, C-09: candidates are repaired by the relations of their features before they count. Each row falls back to
# a point that keeps them, or to where it was
@query(f"""WITH {RELATED_SQL}, v AS (SELECT * FROM cnd WHERE source_row_index IN (SELECT source_row_index FROM flows WHERE label = 0))
  SELECT {P}, count(*) AS targeted_rows, count(*) FILTER (WHERE f_rate <= 40) AS done_before FROM v GROUP BY 1""", ("flows",))
def related_candidate_search(spark, sf):
    rows = related_rows(spark, sf, label=0)
    rate, plan = RELATED.index("f_rate"), replace(PLAN, eps=EPS, steps=2, objective="minimize")
    result, _ = search.hill_climb(
        rows.drop("x").withColumn("x", F.col("x0")).drop("x0"), key="source_row_index", x="x", n=len(RELATED),
        margin=lambda v: F.get(v, F.lit(rate)) - F.lit(40.0 + 1e-9), plan=plan, index=ROLE_INDEX,
    )
    result = cut_lineage(result)
    # a row that moved keeps all relations, bounds and locks; one that broke them before may stay where it was
    moved = result.where("moves > 0")
    broken = moved.where(C.relation_flags(F.col("x_cur"), ROLE_INDEX, 1e-6)["any"]).count()
    if broken:
        raise AssertionError(f"{broken} accepted points break a relation")
    done = F.count(F.when(F.col("baseline_margin") < 0, 1)).alias("done_before")
    return result.groupBy(P).agg(F.count("*").alias("targeted_rows"), done)


# C-17, O-04
@query(f"""WITH m AS (SELECT source_row_index, {P}, epsilon, round(score - threshold, 6) AS base,
      round(least(1::DOUBLE, score + epsilon * k_score) - threshold, 6) AS fin
    FROM flows, (VALUES (0.02::DOUBLE), (0.1)) e(epsilon) WHERE label = 0), q AS (SELECT * FROM m WHERE base < 0)
  SELECT source_row_index, epsilon, 'flip' AS picked_as, fin FROM q WHERE fin >= 0
  UNION ALL SELECT source_row_index, epsilon, 'near_miss', fin FROM (SELECT *, row_number() OVER (PARTITION BY epsilon
    ORDER BY fin DESC, source_row_index) AS rn FROM q WHERE fin < 0) WHERE rn <= 200""", ("flows",))
def hard_negative_select(spark, sf):
    f = flows(spark, sf).where(F.col("label") == 0)
    f = f.withColumn("epsilon", F.explode(F.array(F.lit(0.02), F.lit(0.1))))
    up = F.least(F.lit(1.0), F.col("score") + F.col("epsilon") * F.col("k_score"))
    f = f.select(
        "source_row_index",
        "epsilon",
        F.round(F.col("score") - F.col("threshold"), 6).alias("base"),
        F.round(up - F.col("threshold"), 6).alias("fin"),
    ).withColumn("hit", F.col("fin") >= 0)
    out = perturb.hard_negatives(
        f, by=["epsilon"], baseline="base", final="fin", success="hit", key=["source_row_index"], k=200
    )
    return out.select("source_row_index", "epsilon", "picked_as", "fin")
