"""Contributions, stumps, blends, reports, and Spark ML classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.base import FEATURES, MODELS, THRESHOLDS, flows, line_flows, points_ctes, query, rounded
from flowlens.functions.coerce import classify_outcome
from flowlens.operators import models as M, reports, score, split
from flowlens.operators.rank_metrics import rank_metrics
from flowlens.plans.small import cut_lineage, spread_out

P = "protocol_hint"
SEED = 42


def scored(spark, sf):
    return score.routed_score(flows(spark, sf), MODELS, THRESHOLDS)


CON = """c AS (SELECT *, w_value * value AS c_value, w_k * k AS c_k, w_hr * hr AS c_hr FROM scored),
  l AS (SELECT source_row_index, protocol_used, 'value' AS feature, c_value AS v FROM c UNION ALL
    SELECT source_row_index, protocol_used, 'k', c_k FROM c UNION ALL SELECT source_row_index, protocol_used, 'hr', c_hr FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY source_row_index ORDER BY abs(v) DESC, feature) AS rn FROM l)"""


# L-13, O-05
@query(f"""WITH {CON} SELECT source_row_index, rn AS place, feature, round(v, 6) AS contribution,
  CASE WHEN v >= 0 THEN 'attack' ELSE 'benign' END AS direction FROM r WHERE rn <= 2""", ("flows", "scored"))
def linear_contributions(spark, sf):
    f = score.contributions(scored(spark, sf), MODELS)
    f = f.select("source_row_index", F.posexplode(score.top_contributions("contributions", 2)).alias("i", "c"))
    return rounded(
        f.select(
            "source_row_index",
            (F.col("i") + 1).cast("bigint").alias("place"),
            "c.feature",
            "c.contribution",
            "c.direction",
        )
    )


# A-34
@query(f"""WITH {CON} SELECT protocol_used, feature, round(avg(abs(v)), 6) AS mean_abs, round(avg(v), 6) AS mean_signed FROM l
  GROUP BY 1, 2""", ("flows", "scored"))
def mean_abs_contribution(spark, sf):
    return rounded(score.mean_abs_contribution(scored(spark, sf), MODELS))


@query(f"""WITH {CON}, m AS (SELECT protocol_used, feature, avg(abs(v)) AS a FROM l GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY protocol_used ORDER BY avg(abs(v)) DESC, feature) <= 20)
  SELECT feature, round(sum(a), 6) AS importance FROM m GROUP BY 1 ORDER BY sum(a) DESC LIMIT 25""", ("flows", "scored"))
def overall_importance(spark, sf):
    return rounded(score.overall_importance(score.mean_abs_contribution(scored(spark, sf), MODELS)))


# O-07
@query(f"""WITH {CON}, m AS (SELECT protocol_used, feature, avg(abs(v)) AS mean_abs, avg(v) AS mean_signed FROM l GROUP BY 1, 2)
  SELECT protocol_used, feature, round(mean_abs, 6) AS mean_abs, round(mean_signed, 6) AS mean_signed FROM m
  WHERE mean_signed > 0 AND feature <> 'hr'
  QUALIFY row_number() OVER (PARTITION BY protocol_used ORDER BY mean_signed DESC, feature) <= 1""", ("flows", "scored"))
def positive_unlocked_features(spark, sf):
    m = score.mean_abs_contribution(scored(spark, sf), MODELS)
    return rounded(score.positive_unlocked_features(m, locked=["hr"], k=1))


# L-15
@query(f"""WITH {CON}, o AS (SELECT source_row_index, protocol_used, CASE WHEN label = 1 AND prediction = 1 THEN 'TP'
      WHEN label = 0 AND prediction = 0 THEN 'TN' WHEN label = 0 THEN 'FP' ELSE 'FN' END AS outcome FROM scored),
    k AS (SELECT *, row_number() OVER (PARTITION BY protocol_used, outcome ORDER BY source_row_index) AS n FROM o)
  SELECT printf('%s_%s_%03d', k.protocol_used, outcome, n) AS case_id, k.source_row_index, r.feature AS top_feature,
    round(r.v, 6) AS top_contribution FROM k JOIN r ON r.source_row_index = k.source_row_index AND r.rn = 1 WHERE n <= 5""",
  ("flows", "scored"))
def case_library(spark, sf):
    s = scored(spark, sf).withColumn("outcome", classify_outcome("label", "prediction"))
    lib = reports.case_library(s, MODELS, outcome="outcome", order=["source_row_index"], n=5, top=3)
    top = F.get("contributions", F.lit(0))
    return rounded(
        lib.select(
            "case_id",
            "source_row_index",
            top["feature"].alias("top_feature"),
            top["contribution"].alias("top_contribution"),
        )
    )


# L-18: operating-point table
@query(f"""WITH {points_ctes("flows", P, "score", "Global")}, s AS (SELECT {P} AS scope, label, prediction, threshold FROM flows
      UNION ALL SELECT 'Global', label, prediction, NULL FROM flows), c AS (SELECT scope, max(threshold) AS threshold,
      count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
      count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn
    FROM s GROUP BY 1)
  SELECT c.scope, threshold, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6)
    AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr,
    round(roc_auc, 6) AS roc_auc, round(pr_auc_step, 6) AS pr_auc, tp, tn, fp, fn
  FROM c JOIN ranks ON ranks.scope = c.scope""", ("flows",))
def protocol_table(spark, sf):
    return rounded(
        reports.protocol_table(
            flows(spark, sf), by=P, label="label", pred="prediction", score="score", threshold="threshold"
        )
    )


# L-07
def stump_sql(source: str, features: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT {i} AS o, '{f}' AS feature, {f} AS v, label FROM {source}" for i, f in enumerate(features))
    return f"""WITH l AS ({long}), t AS (SELECT feature, 0.5::DOUBLE * (avg(v) FILTER (WHERE label = 0)
      + avg(v) FILTER (WHERE label = 1)) AS threshold FROM l GROUP BY 1),
    e AS (SELECT l.o, l.feature, t.threshold, avg(CAST((v >= t.threshold) <> (label = 1) AS DOUBLE)) AS err FROM l
      JOIN t ON t.feature = l.feature GROUP BY 1, 2, 3),
    b AS (SELECT o * 2 AS tie, feature, threshold, 1 AS polarity, err FROM e UNION ALL
      SELECT o * 2 + 1, feature, threshold, -1, 1 - err FROM e)
  SELECT feature, round(threshold, 6) AS threshold, polarity, round(err, 6) AS error FROM b ORDER BY err, tie LIMIT 1"""


@query(stump_sql("flows", FEATURES), ("flows",))
def mean_threshold_stump(spark, sf):
    return rounded(M.best_stump(flows(spark, sf), features=FEATURES, label="label"))


@query(stump_sql("line_flows", ["quantity", "price", "discount", "tax"]), ("line_flows",))
def line_stump(spark, sf):
    return rounded(
        M.best_stump(line_flows(spark, sf), features=["quantity", "price", "discount", "tax"], label="label")
    )


WEIGHTS = [{"score": 1.0, "k_score": 0.0}, {"score": 0.5, "k_score": 0.5}, {"score": 0.25, "k_score": 0.75}]


# L-10
@query(f"""WITH bl AS (SELECT b AS blend, label, w * score + (1 - w) * k_score AS s FROM flows,
      (VALUES ('0', 1::DOUBLE), ('1', 0.5), ('2', 0.25)) x(b, w)), {points_ctes("bl", "blend", "s")},
    best AS (SELECT scope, score, tpr, fpr, 2 * tp / (tp + fp + n_pos)::DOUBLE AS f1 FROM rates WHERE fpr <= 0.05::DOUBLE
      QUALIFY row_number() OVER (PARTITION BY scope ORDER BY 2 * tp / (tp + fp + n_pos)::DOUBLE DESC, score DESC) = 1)
  SELECT CAST(best.scope AS INTEGER) AS blend_id, round(best.f1, 6) AS val_f1, round(pr_auc_step, 6) AS val_pr_auc,
    round(best.f1 + 0.05 * pr_auc_step - 0.1 * best.fpr / 0.05, 6) AS objective FROM best JOIN ranks ON ranks.scope = best.scope""",
  ("flows",))
def weighted_ensemble(spark, sf):
    out = M.weighted_ensemble(
        flows(spark, sf), scores=["score", "k_score"], label="label", weights=WEIGHTS, max_fpr=0.05
    )
    return rounded(out.select("blend_id", "val_f1", "val_pr_auc", "objective"))


# ---- fitted models: the optimisers are iterative, so SQL checks who was scored and that the fit is good enough -------

AUC_FLOOR = 0.9
FITTED_SQL = f"""SELECT {P} AS protocol, count(*) AS rows, count(*) AS scored, true AS auc_reached FROM flows
  WHERE split = 'test' GROUP BY 1"""


def fitted(scored_rows, by):
    """Rows, scored rows and whether the ranking is as good as the floor, for every protocol that has rows."""
    scored_rows = cut_lineage(scored_rows.select(by, "label", "score_attack"))  # models score once, the curves read often
    counts = scored_rows.groupBy(F.col(by).alias("protocol")).agg(
        F.count("*").alias("rows"), F.count("score_attack").alias("scored")
    )
    auc = rank_metrics(scored_rows.where(F.col("score_attack").isNotNull()), by=by, score="score_attack", label="label")
    auc = auc.select(F.col("scope").alias("protocol"), (F.col("roc_auc") >= AUC_FLOOR).alias("auc_reached"))
    return counts.join(auc, "protocol", "left")


def newton_sql(steps: int, reg: float, features: list[str] = FEATURES) -> str:
    """The same steps in SQL: standardised rows, sums of slope and curvature, a linear system for each protocol solved by
    elimination, one column after another."""
    d = len(features) + 1
    ids, train = range(d), "FROM flows WHERE split = 'train'"
    stats = ", ".join(f"avg({f}) AS m{i}, CASE WHEN stddev_pop({f}) > 1e-6 THEN stddev_pop({f}) ELSE 1 END AS s{i}" for i, f in enumerate(features, 1))
    ctes = [
        f"st AS (SELECT {P} AS g, min(label) = max(label) AS flat, {stats} {train} GROUP BY 1)",
        "x AS MATERIALIZED (SELECT g, CAST(label AS DOUBLE) AS y, flat, 1::DOUBLE AS z0, "
        + ", ".join(f"({f} - m{i}) / s{i} AS z{i}" for i, f in enumerate(features, 1))
        + f" FROM (SELECT * {train}) f JOIN st ON f.{P} IS NOT DISTINCT FROM st.g)",
        "b0 AS (SELECT g, " + ", ".join(f"0::DOUBLE AS b{i}" for i in ids) + " FROM st)",
    ]
    for k in range(steps):
        score = " + ".join(f"b{i} * z{i}" for i in ids)
        slopes = ", ".join(f"sum((y - p) * z{i}) / count(*) - {reg if i else 0}::DOUBLE * any_value(b{i}) AS r{i}" for i in ids)
        bends = ", ".join(f"sum(p * (1 - p) * z{i} * z{j}) / count(*) + {reg if i == j and i else 0}::DOUBLE AS a{i}_{j}" for i in ids for j in ids)
        ctes.append(f"""h{k} AS MATERIALIZED (SELECT g, {slopes}, {bends} FROM (SELECT x.*, {", ".join(f"b{i}" for i in ids)},
    1 / (1 + exp(-({score}))) AS p FROM x JOIN b{k} b ON x.g IS NOT DISTINCT FROM b.g WHERE NOT flat) GROUP BY g)""")
        last = f"h{k}"
        for c in ids:  # clear column c from all rows but its own
            cells = [f"a{i}_{j} - a{i}_{c} / a{c}_{c} * a{c}_{j} AS a{i}_{j}" if i != c else f"a{i}_{j}" for i in ids for j in ids if j > c]
            cells += [f"a{i}_{i}" for i in ids if i <= c]
            right = [f"r{i} - a{i}_{c} / a{c}_{c} * r{c} AS r{i}" if i != c else f"r{i}" for i in ids]
            ctes.append(f"h{k}_{c} AS (SELECT g, {', '.join(right + cells)} FROM {last})")
            last = f"h{k}_{c}"
        moved = ", ".join(f"b.b{i} + coalesce(r{i} / a{i}_{i}, 0) AS b{i}" for i in ids)
        ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT b.g, {moved} FROM b{k} b LEFT JOIN {last} h ON h.g IS NOT DISTINCT FROM b.g)")
    return f"WITH {', '.join(ctes)} "


def coefficients(spark, models):
    rows = [(g, c, float(v)) for g, m in models.items() for c, v in {"": m.bias, **m.weights}.items()]
    return spark.createDataFrame(rows, "protocol string, feature string, coefficient double")


# L-04: weights and bias after two steps from zero, for all protocols at once
@query(newton_sql(2, 1e-4) + " UNION ALL ".join(
    f"SELECT g AS protocol, '{f}' AS feature, round(b{i}, 6) AS coefficient FROM b2" for i, f in enumerate(["", *FEATURES])), ("flows",))
def logistic_steps(spark, sf):
    train = flows(spark, sf).where(F.col("split") == "train")
    return rounded(coefficients(spark, M.train_logistic(train, features=FEATURES, label="label", by=P, max_iter=2)))


# L-04, L-01: the whole fit, and what it makes of the test rows; a protocol with one class only gets zero weights
@query(newton_sql(9, 1e-4) + f""", s AS (SELECT {P} AS protocol, label, 1 / (1 + exp(-(b0 + {
    " + ".join(f"b{i} * ({f} - m{i}) / s{i}" for i, f in enumerate(FEATURES, 1))}))) AS p
    FROM flows f JOIN b9 ON f.{P} IS NOT DISTINCT FROM b9.g JOIN st ON f.{P} IS NOT DISTINCT FROM st.g WHERE split = 'test')
  SELECT protocol, count(*) AS rows, count(*) FILTER (WHERE label = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND p >= 0.5) AS fp,
    round(avg(p), 5) AS mean_score, round(-avg(ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)), 5) AS loss FROM s GROUP BY 1""", ("flows",))
def train_logistic(spark, sf):
    f = flows(spark, sf)
    models = M.train_logistic(f.where(F.col("split") == "train"), features=FEATURES, label="label", by=P)
    p = F.lit(None).cast("double")
    for g, m in models.items():
        p = F.when(F.col(P).eqNullSafe(F.lit(g)), m.score({c: F.col(c) for c in FEATURES})).otherwise(p)
    s = f.where(F.col("split") == "test").select(F.col(P).alias("protocol"), "label", p.alias("p")).where(F.col("p").isNotNull())
    hit = F.when(F.col("p") >= 0.5, 1)
    out = s.groupBy("protocol").agg(
        F.count("*").alias("rows"),
        F.count(F.when(F.col("label") == 1, hit)).alias("tp"),
        F.count(F.when(F.col("label") == 0, hit)).alias("fp"),
        F.avg("p").alias("mean_score"),
        (-F.avg(F.log(F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p"))))).alias("loss"),
    )
    return rounded(out, 5)


def split_rows(spark, sf):
    """What the fits read, stored: every group's fit goes over it several times."""
    return cut_lineage(flows(spark, sf).select(P, "label", "split", *FEATURES))


# L-05, L-14
@query(f"""SELECT protocol, rows, scored, auc_reached, true AS gains_sum_to_one, 3::BIGINT AS features FROM ({FITTED_SQL})""", ("flows",))
def train_boosted_trees(spark, sf):
    f = split_rows(spark, sf)
    models = M.train_boosted_trees(
        f.where(F.col("split") == "train"), features=FEATURES, label="label", by=P, rounds=3, depth=3
    )
    s = M.score_models(f.where(F.col("split") == "test"), models, features=FEATURES, label="label", by=P)
    gains = M.feature_importance(spark, models, features=FEATURES).groupBy("protocol").agg(
        (F.abs(F.sum("gain") - 1) < 1e-6).alias("gains_sum_to_one"), F.count("*").alias("features")
    )
    return fitted(s, P).join(gains, "protocol", "left")


# L-06
@query(FITTED_SQL, ("flows",))
def train_mlp(spark, sf):
    f = split_rows(spark, sf)
    f = f.withColumns({c: F.col(c) / F.lit(100.0) for c in FEATURES})
    models = M.train_mlp(f.where(F.col("split") == "train"), features=FEATURES, label="label", by=P, hidden=(8,), max_iter=20)
    s = M.score_models(f.where(F.col("split") == "test"), models, features=FEATURES, label="label", by=P)
    return fitted(s, P)


def boosted_sql(rounds: int) -> str:
    """Each round: class means weighted so far, the error of every feature and direction, the best one, new weights."""
    long = " UNION ALL ".join(
        f"SELECT {i} AS o, '{f}' AS feature, {f} AS v, label, source_row_index AS id FROM flows" for i, f in enumerate(FEATURES)
    )
    ctes = [f"l AS MATERIALIZED ({long})", "w0 AS (SELECT source_row_index AS id, 1::DOUBLE AS w FROM flows)"]
    for r in range(rounds):
        ctes.append(f"""x{r} AS MATERIALIZED (SELECT l.*, w FROM l JOIN w{r} ON w{r}.id = l.id),
    t{r} AS (SELECT feature, 0.5::DOUBLE * (sum(w * v) FILTER (WHERE label = 0) / sum(w) FILTER (WHERE label = 0)
      + sum(w * v) FILTER (WHERE label = 1) / sum(w) FILTER (WHERE label = 1)) AS threshold FROM x{r} GROUP BY 1),
    e{r} AS (SELECT o, x{r}.feature, threshold, sum(w * CAST((v >= threshold) <> (label = 1) AS DOUBLE)) / sum(w) AS err
      FROM x{r} JOIN t{r} ON t{r}.feature = x{r}.feature GROUP BY 1, 2, 3),
    b{r} AS MATERIALIZED (SELECT *, 0.5::DOUBLE * ln((1 - c) / c) AS alpha FROM (SELECT *, least(greatest(err, 1e-8), 0.499999) AS c
      FROM (SELECT o * 2 AS tie, feature, threshold, 1 AS polarity, err FROM e{r} UNION ALL
        SELECT o * 2 + 1, feature, threshold, -1, 1 - err FROM e{r})) ORDER BY err, tie LIMIT 1),
    w{r + 1} AS MATERIALIZED (SELECT x{r}.id, w * exp(CASE WHEN ((v >= threshold) = (polarity = 1)) = (label = 1) THEN -alpha ELSE alpha END) AS w
      FROM x{r} JOIN b{r} ON b{r}.feature = x{r}.feature)""")
    out = " UNION ALL ".join(
        f"SELECT {r} AS round, feature, round(threshold, 5) AS threshold, polarity, round(alpha, 5) AS alpha FROM b{r}" for r in range(rounds)
    )
    return f"WITH {', '.join(ctes)} {out}"


BOOSTED = 5


# L-08
@query(boosted_sql(BOOSTED), ("flows",))
def adaboost_stumps(spark, sf):
    f = flows(spark, sf).select("source_row_index", P, "label", *FEATURES)
    stumps = M.adaboost_stumps(f, features=FEATURES, label="label", rounds=BOOSTED)
    rows = [(i, s["feature"], float(s["threshold"]), int(s["polarity"]), float(s["alpha"])) for i, s in enumerate(stumps)]
    return rounded(spark.createDataFrame(rows, "round int, feature string, threshold double, polarity int, alpha double"), 5)


def boosted_votes_sql(rounds: int) -> str:
    votes = " + ".join(
        f"(SELECT CASE WHEN (CASE b.feature {' '.join(f"WHEN '{f}' THEN f.{f}" for f in FEATURES)} END >= b.threshold) = (b.polarity = 1) THEN b.alpha ELSE -b.alpha END FROM b{r} b)"
        for r in range(rounds)
    )
    ctes = boosted_sql(rounds).rpartition(" SELECT 0 AS round")[0]
    return f"{ctes} SELECT source_row_index, round(1 / (1 + exp(-2 * ({votes}))), 5) AS score FROM flows f"


# L-08: the ensemble's score of every row
@query(boosted_votes_sql(BOOSTED), ("flows",))
def adaboost_scores(spark, sf):
    f = flows(spark, sf).select("source_row_index", P, "label", *FEATURES)
    stumps = M.adaboost_stumps(f, features=FEATURES, label="label", rounds=BOOSTED)
    return rounded(f.select("source_row_index", M.adaboost_score(stumps).alias("score")), 5)


def train_rows(spark, sf):
    """Train rows, stored: the split reads them twice."""
    f = flows(spark, sf).where(F.col("split") == "train")
    return cut_lineage(spread_out(f.select("source_relpath", "source_row_index", P, "label", *FEATURES)))


# L-09: tuned on the validation rows of the leakage-safe split of the train rows
@query("""SELECT trial, CASE WHEN trial < 2 THEN 'coarse' ELSE 'refine' END AS stage, 'ok' AS status, true AS feasible
  FROM range(3) r(trial) WHERE (SELECT count(*) FROM flows) > 0""", ("flows",))
def tune_trials(spark, sf):
    marked, _ = split.capture_val_split(
        train_rows(spark, sf), strata=[P, "label"], capture="source_relpath", row="source_row_index", seed=SEED
    )
    marked = cut_lineage(marked.select(P, "label", "is_val", *FEATURES))  # fitted and scored once a trial
    out = M.tune_trials(
        marked.where(~F.col("is_val")), marked.where("is_val"), features=FEATURES, label="label", by=P, max_fpr=0.05, coarse=2, refine=1
    )
    good = F.col("objective").isNotNull() & ~F.isnan("objective") & (F.col("objective") > 0.5)
    return out.select(F.col("trial").cast("bigint").alias("trial"), "stage", "status", good.alias("feasible"))


# L-12: every protocol gets a decision on the validation rows of the leakage-safe split of the train rows, and its threshold
# keeps both campaigns' gates or says so
@query(f"""SELECT {P} AS scope, true AS decided, true AS consistent FROM flows WHERE split = 'train' GROUP BY 1""", ("flows",))
def robust_refit(spark, sf):
    from flowlens.operators import constraints as C

    marked, _ = split.capture_val_split(
        train_rows(spark, sf), strata=[P, "label"], capture="source_relpath", row="source_row_index", seed=SEED
    )
    f = cut_lineage(marked.select("source_row_index", P, "label", "is_val", *FEATURES))
    train, val = f.where(~F.col("is_val")), f.where("is_val")
    con = C.feature_constraints(train, by=P, features=FEATURES, semantic_locks=["hr"])
    prof = C.profile_arrays(con, by=P, features=FEATURES, caps={x: 0.5 for x in FEATURES})
    gates = {"clean_fpr_max": 0.2, "attacked_fpr_max": 0.25, "adv_recall_min": 0.6}
    out = reports.robust_refit(
        train, val, prof, features=FEATURES, label="label", by=P, key=["source_row_index"], eps=0.1, gates=gates
    )
    inside = (F.col("clean_fpr") <= 0.2) & (F.col("attacked_benign_fpr") <= 0.25) & (F.col("attacked_malicious_recall") >= 0.6)
    # the benign campaign can only raise alerts
    ordered = F.col("attacked_benign_fpr") >= F.col("clean_fpr")
    return out.select("scope", F.col("selected_threshold").between(0, 1).alias("decided"), ((F.col("gate_pass").cast("boolean") == inside) & ordered).alias("consistent"))
