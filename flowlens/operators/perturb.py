"""Bounded perturbations of attack rows against a linear surrogate, and how scores respond to them.

Rows carry the protocol profile arrays of ``constraints``. Each perturbation is an expression over the row; all
scenarios of a row are scored inside one projection and counted in one aggregate.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.numeric import clip, l2_norm, max_abs, passes, placeable, ratio, sigmoid, stable_sigmoid
from flowlens.operators.constraints import each, let, project_bounds
from flowlens.operators.metrics import GLOBAL_SCOPE, worst_case
from flowlens.operators.score import LinearModel, by_protocol
from flowlens.plans.ordered import array_position, best_row, first_k
from flowlens.plans.quantiles import wide_quantiles
from flowlens.plans.small import cut_lineage, null_safe_join, once_per_row, pinned


def attach_surrogate(df: DataFrame, models: dict[str, LinearModel], features: list[str], *, by: str) -> DataFrame:
    """Add ``s_w, s_mean, s_std`` arrays and ``s_b`` of the row's protocol."""

    def arr(get) -> dict[str, Column]:
        return {p: F.array(*[F.lit(float(get(m, f))) for f in features]) for p, m in models.items()}

    key = F.col(by)
    return once_per_row(
        df,
        {
            "s_w": by_protocol(key, arr(lambda m, f: m.weights.get(f, 0.0))),
            "s_mean": by_protocol(key, arr(lambda m, f: m.mean.get(f, 0.0))),
            "s_std": by_protocol(key, arr(lambda m, f: m.std.get(f, 1.0))),
            "s_b": by_protocol(key, {p: F.lit(float(m.bias)) for p, m in models.items()}),
        },
    )


def surrogate_logit(x: Column, n: int) -> Column:
    def total(v: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(n - 1)),
            F.col("s_b"),
            lambda acc, i: acc + F.get("s_w", i) * (F.get(v, i) - F.get("s_mean", i)) / F.get("s_std", i),
        )

    return let(x, total)


def surrogate_score(x: Column, n: int) -> Column:
    return stable_sigmoid(surrogate_logit(x, n))


def stored_score(x: Column, n: int) -> Column:
    """``surrogate_score`` of a stored column, in plain arithmetic, which is compiled where lambdas are interpreted."""
    z = F.col("s_b")
    for i in range(n):
        z = z + F.get("s_w", F.lit(i)) * (F.get(x, F.lit(i)) - F.get("s_mean", F.lit(i))) / F.get("s_std", F.lit(i))
    return sigmoid(clip(z, -40.0, 40.0))


def _step(p: Column, i: Column, up: bool = False) -> Column:
    """Direction that lowers the attack probability (raises it for ``up``); none where it has rounded to the far end."""
    flat = (p <= 0.0) if up else (p >= 1.0)
    toward = F.signum(F.get("s_w", i))
    return F.when(F.get("p_locked", i) | flat, F.lit(0.0)).otherwise(toward if up else -toward)


def shift_fgsm(x: Column, n: int, eps: float, up: bool = False) -> Column:
    """One sign step of size eps standard deviations, back inside the bounds. ``up`` makes benign rows look like attacks."""
    if eps <= 0:
        return x
    p = surrogate_score(x, n)
    moved = let(p, lambda q: each(n, lambda i: F.get(x, i) + F.lit(float(eps)) * F.get("s_std", i) * _step(q, i, up)))
    return project_bounds(moved, x, n)


def fgsm_columns(df: DataFrame, features: list[str], eps: float, up: bool = False) -> DataFrame:
    """The rows with their features moved as by ``shift_fgsm``, in plain arithmetic, which is compiled where lambdas are
    interpreted. Rows carry the profile and surrogate arrays; ``x`` holds the features before the move."""
    if eps <= 0:
        return df
    df = once_per_row(df, {"__p": stored_score(F.col("x"), len(features))})

    def moved(i: Column) -> Column:
        at = F.get("x", i)
        to = at + F.lit(float(eps)) * F.get("s_std", i) * _step(F.col("__p"), i, up)
        return F.when(F.get("p_locked", i), at).otherwise(F.least(F.greatest(to, F.get("p_lower", i)), F.get("p_upper", i)))

    # one by one: a filter on what is scored from them would else take their expressions along
    for i, f in enumerate(features):
        df = once_per_row(df, {f: moved(F.lit(i))})
    return df.drop("__p")


def shift_pgd(x: Column, n: int, eps: float, steps: int = 10, alpha_ratio: float = 0.25) -> Column:
    """Repeated sign steps inside an eps ball and the bounds; the loop runs inside the row."""
    if eps <= 0:
        return x
    steps = max(1, int(steps))
    alpha = max(0.0, alpha_ratio) * eps or eps / steps

    def once(acc: Column, _k: Column) -> Column:
        def moved(q: Column) -> Column:
            def one(i: Column) -> Column:
                std, x0 = F.get("s_std", i), F.get(x, i)
                shift = (F.get(acc, i) - x0) / std + F.lit(alpha) * _step(q, i)
                return x0 + F.least(F.greatest(shift, F.lit(-eps)), F.lit(eps)) * std

            return project_bounds(each(n, one), x, n)

        return let(surrogate_score(acc, n), moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, once)


def attach_top_features(df: DataFrame, chosen: DataFrame, features: list[str], *, by: str, name: str = "top") -> DataFrame:
    """Positions in ``features`` of each protocol's chosen ones (``protocol_used, feature``); none where nothing is chosen."""
    at = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
    lists = chosen.groupBy(F.col("protocol_used").alias(by)).agg(F.sort_array(F.collect_list(at.cast("int"))).alias(name))
    out = null_safe_join(df, lists, [by], "left")  # a row for each protocol, of at most k positions
    return out.withColumn(name, F.coalesce(name, F.array().cast("array<int>")))


def shift_topk(x: Column, n: int, eps: float, top: Column) -> Column:
    """Lower the listed feature positions by eps of their span."""
    if eps <= 0:
        return x
    moved = each(
        n,
        lambda i: F.get(x, i)
        - F.when(F.array_contains(top, i), F.lit(float(eps)) * F.greatest(F.get("p_upper", i) - F.get("p_lower", i), F.lit(0.0)))
        .otherwise(F.lit(0.0)),
    )
    return project_bounds(moved, x, n)


SHIFTS = {"fgsm": shift_fgsm, "pgd": shift_pgd}


def scenario_list(methods: list[str], epsilons: list[float]) -> list[tuple[str, float]]:
    return [("baseline", 0.0)] + [(m, e) for m in methods for e in epsilons]


def scenario_scores(
    df: DataFrame, *, x: str, n: int, label: str, scenarios: list[tuple[str, float]], score=surrogate_score
) -> DataFrame:
    """Add ``scores``: one value per scenario. Benign rows keep their clean score."""
    col = F.col(x)
    df = once_per_row(df, {"clean_score": score(col, n)})
    cells = []
    for method, eps in scenarios:
        if method == "baseline" or eps <= 0:
            cells.append(F.col("clean_score"))
        else:
            attacked = score(SHIFTS[method](col, n, eps), n)
            cells.append(F.when(F.col(label) == 1, attacked).otherwise(F.col("clean_score")))
    return once_per_row(df, {"scores": F.array(*cells)})


def _scenario_rows(scenarios: list[tuple[str, float]], cells: list[Column]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(m).alias("method"), F.lit(float(e)).alias("epsilon"), cells[i].alias("c"))
            for i, (m, e) in enumerate(scenarios)
        ]
    )


def scenario_counts(
    df: DataFrame, *, by: str, label: str, threshold: str, scenarios: list[tuple[str, float]]
) -> DataFrame:
    """Confusion and attack-success counts per protocol and scenario, in one wide aggregate over the rows."""
    y, thr = F.col(label), F.col(threshold)

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, F.lit(1)))

    hit0 = passes(F.get("scores", F.lit(0)), thr)
    aggs, cells = [], []
    for i, _ in enumerate(scenarios):
        hit = passes(F.get("scores", F.lit(i)), thr)
        parts = {
            "tp": (y == 1) & hit,
            "tn": (y == 0) & ~hit,
            "fp": (y == 0) & hit,
            "fn": (y == 1) & ~hit,
            "asr_num": (y == 1) & hit0 & ~hit,
            "asr_den": (y == 1) & hit0,
        }
        aggs += [count(c).alias(f"{k}_{i}") for k, c in parts.items()]
        cells.append(F.struct(*[F.col(f"{k}_{i}").alias(k) for k in parts]))
    wide = df.groupBy(by).agg(*aggs)
    return wide.select(by, F.explode(_scenario_rows(scenarios, cells)).alias("s")).select(
        by, "s.method", "s.epsilon", "s.c.*"
    )


COUNTS = ["tp", "tn", "fp", "fn", "asr_num", "asr_den"]


def scenario_metrics(counts: DataFrame, *, by: str) -> DataFrame:
    """Ratios per scope and scenario with the change against the baseline of the scope."""
    keys = ["scope", "method", "epsilon"]
    per = counts.withColumnRenamed(by, "scope")
    total = per.groupBy("method", "epsilon").agg(*[F.sum(c).alias(c) for c in COUNTS])
    both = per.unionByName(total.withColumn("scope", F.lit(GLOBAL_SCOPE)).select(*per.columns))
    m = both.withColumns(
        {
            "precision": ratio("tp", F.expr("tp + fp")),
            "recall": ratio("tp", F.expr("tp + fn")),
            "f1": ratio(F.expr("2 * tp"), F.expr("2 * tp + fp + fn"), "zero"),
            "fpr": ratio("fp", F.expr("fp + tn")),
            "asr_conditional": ratio("asr_num", "asr_den"),
            "asr_all": ratio("fn", F.expr("tp + fn")),
        }
    )
    base = F.max(F.when(F.col("method") == "baseline", F.col("f1"))).over(Window.partitionBy("scope"))
    return m.withColumn("delta_f1", F.col("f1") - base).select(
        *keys, "tp", "tn", "fp", "fn", "precision", "recall", "f1", "fpr", "asr_conditional", "asr_all", "delta_f1"
    )


def perturbation_stats(df: DataFrame, *, x: str, adv: str, n: int, by: list[str]) -> DataFrame:
    """Mean, median and 95th percentile of the size of the moves: cells changed, L2, Linf, and both per span."""
    delta = each(n, lambda i: F.get(F.col(adv), i) - F.get(F.col(x), i))
    rows = once_per_row(df, {"__d": delta})
    scaled = each(
        n, lambda i: F.get("__d", i) / F.when(F.get("p_span", i) > 1e-12, F.get("p_span", i)).otherwise(F.lit(1.0))
    )
    rows = once_per_row(rows, {"__s": scaled})
    measures = {
        "l0": F.size(F.filter("__d", lambda v: F.abs(v) > 1e-12)).cast("double"),
        "l2": l2_norm("__d"),
        "linf": max_abs("__d"),
        "l2_norm": l2_norm("__s"),
        "linf_norm": max_abs("__s"),
    }
    # five numbers a row are stored, since their quantiles need three looks and the moves are costly
    narrow = cut_lineage(rows.select(*by, *[v.alias(k) for k, v in measures.items()]))
    means = narrow.groupBy(*by).agg(*[f(k).alias(f"{s}_{k}") for k in measures for s, f in (("n", F.count), ("m", F.avg))])
    cells = [F.struct(F.lit(k).alias("measure"), F.col(f"n_{k}").alias("rows"), F.col(f"m_{k}").alias("mean")) for k in measures]
    mean = means.select(*by, F.inline(F.array(*cells)))
    q = wide_quantiles(narrow, by, {k: F.col(k) for k in measures}, {"median": 0.5, "p95": 0.95}, "measure")
    return null_safe_join(mean, q.select(*by, "measure", "median", "p95"), [*by, "measure"])


def changed_rows(x: str, adv: str, n: int, tol: float = 1e-9) -> Column:
    return F.exists(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.abs(F.get(F.col(adv), i) - F.get(F.col(x), i)) > tol
    )


def tuning_grid(base: dict[str, float], deltas: list[float]) -> dict[str, list[float]]:
    return {p: sorted({min(1.0, max(0.0, t + d)) for d in deltas} | {t}) for p, t in base.items()}


def threshold_scenario_counts(
    df: DataFrame, *, by: str, label: str, scenarios: list[tuple[str, float]], grid: dict[str, list[float]]
) -> DataFrame:
    """Counts at or above every candidate threshold per protocol and scenario.

    Scores are bucketed against the protocol's few candidates and counted once; candidates then share the buckets.
    """
    spark = df.sparkSession
    size = max(len(g) for g in grid.values())
    grids = pinned(spark.createDataFrame([(p, g) for p, g in grid.items()], f"{by} string, grid array<double>"))
    rows = df.select(by, label, F.posexplode("scores").alias("scenario", "score"))
    hist = (
        null_safe_join(rows, grids, [by])
        .withColumn("idx", array_position(F.col("grid"), placeable("score"), size, inclusive=True))
        .groupBy(by, "scenario", "idx")
        .agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg"))
    )
    cells = [(p, i, s, t) for p, g in grid.items() for s in range(len(scenarios)) for i, t in [(0, None), *enumerate(g, 1)]]
    dense = null_safe_join(
        spark.createDataFrame(cells, f"{by} string, idx int, scenario int, threshold double"),
        hist,
        [by, "scenario", "idx"],
        "left",
    ).fillna(0, ["pos", "neg"])
    above = Window.partitionBy(by, "scenario").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by, "scenario")
    return dense.select(
        by,
        "scenario",
        "threshold",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("n_pos"),
        F.sum("neg").over(whole).alias("n_neg"),
    ).where(F.col("threshold").isNotNull())


def threshold_combos(spark, grid: dict[str, list[float]], base: dict[str, float], *, by: str) -> DataFrame:
    """Every combination of per-protocol candidates, long: ``(combo, protocol, threshold, shift, is_base)``.

    The grids are parameters (a handful of values per protocol), so the combinations are generated, not joined.
    """
    names = list(grid)
    rows = []
    for c, combo in enumerate(itertools.product(*[grid[p] for p in names])):
        is_base = all(t == base[p] for p, t in zip(names, combo))
        rows += [(c, p, t, abs(t - base[p]), is_base) for p, t in zip(names, combo)]
    return spark.createDataFrame(
        rows, f"combo int, {by} string, threshold double, shift double, is_base boolean"
    )


def guarded_tune(
    df: DataFrame,
    *,
    by: str,
    label: str,
    scenarios: list[tuple[str, float]],
    base: dict[str, float],
    deltas: list[float],
    max_clean_fpr_increase: float = 0.0,
    max_attacked_fpr_increase: float = 0.0,
    max_recall_drop: float = 0.002,
    max_f1_drop: float = 0.002,
) -> DataFrame:
    """Score every threshold combination, mark the four guards against the base thresholds, and rank.

    Guarded rows come first (all rows when none passes): clean F1, worst robust F1, worst adversarial recall, clean
    FPR, then the smallest shift. ``rank = 1`` is the choice.
    """
    spark = df.sparkSession
    grid = tuning_grid(base, deltas)
    counts = pinned(
        threshold_scenario_counts(df, by=by, label=label, scenarios=scenarios, grid=grid), max_rows=200_000
    )
    combos = threshold_combos(spark, grid, base, by=by)
    sums = null_safe_join(combos, counts, [by, "threshold"]).groupBy("combo", "scenario").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "n_pos", "n_neg")]
    )
    m = sums.withColumns(
        {
            "precision": ratio("tp", F.expr("tp + fp")),
            "recall": ratio("tp", "n_pos"),
            "f1": ratio(F.expr("2 * tp"), F.expr("tp + fp + n_pos"), "zero"),
            "fpr": ratio("fp", "n_neg"),
        }
    )
    names = spark.createDataFrame(
        [(i, f"{s}@eps={e}", e > 0) for i, (s, e) in enumerate(scenarios)], "scenario int, key string, attacked boolean"
    )
    m = null_safe_join(m, names, ["scenario"])
    clean = m.where(F.col("scenario") == 0).select(
        "combo",
        *[F.col(c).alias(f"clean_{c}") for c in ("precision", "recall", "f1", "fpr")],
    )
    worst = worst_case(m.where("attacked"), by=["combo"], key="key", fpr="fpr", recall="recall", f1="f1")
    info = combos.groupBy("combo").agg(
        F.sum("shift").alias("threshold_l1_shift"),
        F.some("is_base").alias("is_base"),
        *[F.max(F.when(F.col(by) == p, F.col("threshold"))).alias(f"{p}_threshold") for p in grid],
    )
    rows = null_safe_join(null_safe_join(info, clean, ["combo"]), worst, ["combo"])
    measures = ["clean_fpr", "worst_attacked_benign_fpr", "worst_adv_malicious_recall", "worst_robust_f1"]
    b = {c: F.max(F.when(F.col("is_base"), F.col(c))).over(Window.partitionBy()) for c in measures}

    def guard(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    rows = rows.withColumns(
        {
            "pass_clean_fpr_guard": guard(F.col("clean_fpr") <= b["clean_fpr"] + max_clean_fpr_increase),
            "pass_attacked_benign_fpr_guard": guard(
                F.col("worst_attacked_benign_fpr") <= b["worst_attacked_benign_fpr"] + max_attacked_fpr_increase
            ),
            "pass_adv_recall_guard": guard(
                F.col("worst_adv_malicious_recall") >= b["worst_adv_malicious_recall"] - max_recall_drop
            ),
            "pass_robust_f1_guard": guard(F.col("worst_robust_f1") >= b["worst_robust_f1"] - max_f1_drop),
        }
    )
    rows = rows.withColumn(
        "guard_pass",
        F.col("pass_clean_fpr_guard")
        & F.col("pass_attacked_benign_fpr_guard")
        & F.col("pass_adv_recall_guard")
        & F.col("pass_robust_f1_guard"),
    )
    rows = rows.withColumn(
        "selection_mode",
        F.when(F.some("guard_pass").over(Window.partitionBy()), F.lit("guarded")).otherwise(
            F.lit("fallback_no_guard_pass")
        ),
    )
    order = [
        F.col("guard_pass").desc(),
        F.col("clean_f1").desc(),
        F.col("worst_robust_f1").desc(),
        F.col("worst_adv_malicious_recall").desc(),
        F.col("clean_fpr").asc(),
        F.col("threshold_l1_shift").asc(),
        F.col("combo").asc(),
    ]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))


def guarded_best(ranked: DataFrame) -> DataFrame:
    return best_row(ranked, [], [F.col("rank")])


def hard_negatives(
    df: DataFrame, *, by: list[str], baseline: str, final: str, success: str, key: list[str], k: int
) -> DataFrame:
    """Benign rows that crossed the threshold, plus the ``k`` nearest misses per group.

    ``baseline`` and ``final`` are margins; rows that were false alarms to begin with are left out.
    """
    quiet = df.where(F.col(baseline) < 0)
    flip = (F.col(final) >= 0) & F.col(success)
    flips = quiet.where(flip).withColumn("picked_as", F.lit("flip"))
    misses = first_k(quiet.where(~flip), by, [F.col(final).desc(), *[F.col(c) for c in key]], k)
    return flips.unionByName(misses.withColumn("picked_as", F.lit("near_miss")))
