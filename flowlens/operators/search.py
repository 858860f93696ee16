"""Budgeted hill-climbing over feature moves, as an iterative DataFrame job.

Each step proposes a few sparse moves per active row, scores them, repairs and scores the best again, and keeps the best
of those, all inside one projection: candidates live in an array of the row, so a step needs no shuffle. Moves are seeded by
md5 hashes of (row key, step, candidate, feature), so that any engine draws the same ones. Only rows that are still open are
written anew, to reliable storage; finished ones stay where the step that ended them left them. One aggregate row decides
whether to go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.hashing import unit_hash
from flowlens.operators.constraints import clipped, max_delta, project_row
from flowlens.plans.ordered import exact_quantiles, order_cutoffs
from flowlens.plans.small import cut_lineage, null_safe_join, once_per_row


@dataclass(frozen=True)
class SearchPlan:
    eps: float
    budget: int
    steps: int = 20
    candidates: int = 8
    subset: int = 3
    refine: int = 2
    objective: str = "minimize"
    active_cap: int | None = None
    patience: int | None = None
    min_delta: float = 1e-6
    seed: int = 42


#: Expressions of hashes that one operator holds: its generated code stays short enough to be compiled to machine code.
AT_ONCE = 4


def _stored(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``once_per_row``, a few columns at a time."""
    items = list(columns.items())
    for at in range(0, len(items), AT_ONCE):
        df = once_per_row(df, dict(items[at : at + AT_ONCE]))
    return df


def _proposed(df: DataFrame, cand: int, n: int, plan: SearchPlan, margin: Callable[[Column], Column]) -> DataFrame:
    """Add ``__t<cand>``, a struct ``(absent, m, x)`` of one candidate: a random subset of 1..subset unlocked features moved by
    35..100 % of their allowance, mostly towards the goal. A row whose width is less than ``cand`` has it as absent.

    Features are plain columns here, as lambdas over arrays are interpreted and not compiled.
    """
    features = range(n)

    def unit(*parts: object) -> Column:
        return unit_hash("__start", F.lit("#".join(str(x) for x in (cand, *parts))), seed=plan.seed)

    here = F.lit(cand) <= F.col("__width")
    nowhere = F.lit(2.0)  # beyond every draw
    width = F.when(here, F.floor(unit("width") * F.lit(plan.subset)).cast("int") + F.lit(1)).otherwise(F.lit(1))
    draws = {"__w": width}
    for i in features:
        free = F.coalesce(~F.get("p_locked", F.lit(i)) & (F.get("__cap", F.lit(i)) > 1e-12), F.lit(False))
        draws[f"__u{i}"] = F.when(here & free, unit(i)).otherwise(nowhere)
    df = _stored(df, draws)
    order = F.sort_array(F.array(*[F.struct(F.col(f"__u{i}").alias("u"), F.lit(i).alias("i")) for i in features]))
    df = once_per_row(df, {"__last": F.get(order, F.least(F.col("__w"), F.lit(n)) - 1)})
    towards = -1.0 if plan.objective == "minimize" else 1.0

    def moved(i: int) -> Column:
        u, last = F.col(f"__u{i}"), F.col("__last.u")
        chosen = (u < nowhere) & ((u < last) | ((u == last) & (F.lit(i) <= F.col("__last.i"))))
        cap = F.get("__cap", F.lit(i))
        size = F.lit(0.35) + F.lit(0.65) * unit(i, "size")
        sign = F.when(unit(i, "sign") < 0.65, F.lit(towards)).otherwise(F.lit(-towards))
        return F.get("x_cur", F.lit(i)) + F.when(chosen, sign * size * cap).otherwise(F.lit(0.0))

    df = _stored(df, {f"__m{i}": moved(i) for i in features})
    df = _stored(df, {f"__m{i}": clipped(F.col(f"__m{i}"), i, F.col("x0"), F.col("__cap")) for i in features})
    df = once_per_row(df, {"__x": F.array(*[F.col(f"__m{i}") for i in features])})
    score = -margin(F.col("__x")) if plan.objective != "minimize" else margin(F.col("__x"))
    cell = F.struct((~here).alias("absent"), score.alias("m"), F.col("__x").alias("x"))
    df = once_per_row(df, {f"__t{cand}": cell})
    return df.drop("__w", "__last", "__x", *[f"__{k}{i}" for k in "um" for i in features])


def hill_climb(
    df: DataFrame,
    *,
    key: str,
    x: str,
    n: int,
    margin: Callable[[Column], Column],
    plan: SearchPlan,
    index: dict[str, int] | None = None,
) -> tuple[DataFrame, dict[str, float]]:
    """Search every row of ``df`` (which carries profile arrays). Returns the final state and run counters.

    ``margin`` maps a feature array, which is a stored column, to score minus threshold; success means crossing zero.
    """
    index = index or {}
    low = plan.objective == "minimize"
    goal = (lambda m: m < 0) if low else (lambda m: m >= 0)
    signed = (lambda m: m) if low else (lambda m: -m)
    state = df.withColumns({"x0": F.col(x), "x_cur": F.col(x), "__cap": max_delta(F.col(x), n, plan.eps)})
    state = state.withColumn("margin", margin(F.col("x0"))).withColumns(
        {"baseline_margin": F.col("margin"), "queries": F.lit(0), "moves": F.lit(0), "success": goal(F.col("margin"))}
    )
    state = cut_lineage(state)
    columns = state.columns
    is_open = ~F.col("success") & (F.col("queries") < plan.budget)
    finished, frontier = [state.where(~is_open)], state.where(is_open)
    info = {"steps": 0, "progress_steps": 0, "stagnated": 0, "active_total": 0, "active_max": 0}
    stale = 0
    for step in range(max(1, plan.steps)):
        active, waiting = frontier, None
        if plan.active_cap:
            active, waiting = _nearest(frontier, [-F.col("margin") if low else F.col("margin"), F.col(key)], plan.active_cap)
        marked = active.withColumn("__active", F.lit(True))
        left = F.lit(plan.budget) - F.col("queries")
        reserve = F.when((left > 2) & F.lit(plan.candidates > 1), F.least(F.lit(plan.refine), left - 1)).otherwise(0)
        width = F.least(F.lit(plan.candidates), F.greatest(F.lit(1), left - reserve))
        reserve = F.when(width <= 1, F.lit(0)).otherwise(reserve)
        width = F.when(reserve > 0, width).otherwise(F.least(F.lit(plan.candidates), left))
        start = F.concat_ws("#", F.col(key).cast("string"), F.lit(str(step)))  # of what every draw of the step hashes
        stepped = once_per_row(marked, {"__width": width, "__refine": F.least(reserve, width), "__start": start})
        judged = F.when(F.col("__refine") > 0, F.col("__refine")).otherwise(F.col("__width"))

        def repaired() -> list[Column]:
            """The candidates that are judged, fully projected (relations repaired, else back to the current point) and
            scored anew; one struct of margin and vector for each place, NULL where there is no candidate."""
            nonlocal stepped
            cells = []
            for i in range(max(plan.refine, 2)):
                here = F.col("__active") & (F.lit(i) < judged)
                candidate = F.when(here, F.get("__scored", F.lit(i))["x"]).otherwise(F.col("x_cur"))
                stepped = once_per_row(stepped, {"__candidate": candidate})
                stepped = project_row(
                    stepped, candidate="__candidate", original="x0", reference="x_cur", index=index, n=n, eps=plan.eps, out=f"__p{i}"
                )
                point = F.col(f"__p{i}")
                cell = F.when(here, F.struct(signed(margin(point)).alias("m"), point.alias("x")))
                stepped = once_per_row(stepped, {f"__j{i}": cell})
                cells.append(F.col(f"__j{i}"))
            return cells

        candidates = [f"__t{c}" for c in range(1, plan.candidates + 1)]
        for c in range(1, plan.candidates + 1):
            stepped = _proposed(stepped, c, n, plan, margin)
        stepped = once_per_row(stepped, {"__scored": F.sort_array(F.array(*candidates))}).drop(*candidates)
        cells = repaired()
        stepped = once_per_row(stepped, {"__best": F.array_min(F.array(*cells))})
        better = F.col("__active") & F.coalesce(F.col("__best.m") < signed(F.col("margin")) - 1e-9, F.lit(False))
        stepped = stepped.withColumn("__better", better)
        new_margin = F.when(F.col("__better"), signed(F.col("__best.m"))).otherwise(F.col("margin"))
        stepped = stepped.withColumn("__before", F.when(F.col("__active"), signed(F.col("margin")))).withColumns(
            {
                "x_cur": F.when(F.col("__better"), F.col("__best.x")).otherwise(F.col("x_cur")),
                "margin": new_margin,
                "moves": F.col("moves") + F.col("__better").cast("int"),
                "queries": F.col("queries")
                + F.when(F.col("__active"), F.col("__width") + F.col("__refine")).otherwise(F.lit(0)),
                "success": goal(new_margin),
            }
        )
        stepped = cut_lineage(stepped.select(*columns, "__before"))
        row = stepped.agg(
            F.count("*").alias("active"),
            F.min("__before").alias("before"),
            F.min(signed(F.col("margin"))).alias("after"),
        ).first()
        if not row["active"]:
            break
        stepped = stepped.drop("__before")
        finished.append(stepped.where(~is_open))
        frontier = stepped.where(is_open)
        if waiting is not None:
            frontier = frontier.unionByName(waiting)
        info["steps"] += 1
        info["active_total"] += row["active"]
        info["active_max"] = max(info["active_max"], row["active"])
        if row["before"] - row["after"] > plan.min_delta:
            info["progress_steps"] += 1
            stale = 0
        else:
            stale += 1
            if plan.patience and stale >= plan.patience:
                info["stagnated"] = 1
                break
    out = frontier
    for part in finished:
        out = out.unionByName(part)
    return out.drop("__cap"), info


def _nearest(frontier: DataFrame, order: list[Column], cap: int) -> tuple[DataFrame, DataFrame]:
    """The first ``cap`` rows by ``order`` and the others, told apart by a cut-off in place."""
    one = frontier.withColumn("__scope", F.lit(0))
    cut = order_cutoffs(one, ["__scope"], order, frontier.sparkSession.createDataFrame([(0, cap)], "__scope int, target long"))
    own = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)])
    marked = null_safe_join(one.withColumn("__own", own), cut, ["__scope"], "left")
    inside = F.coalesce(F.col("take_all") | (F.col("__own") <= F.col("cutoff")), F.lit(False))
    marked = marked.withColumn("__in", inside).drop("__scope", "__own", "take_all", "cutoff")
    return marked.where("__in").drop("__in"), marked.where("not __in").drop("__in")


def campaign_stats(result: DataFrame, *, by: list[str]) -> DataFrame:
    """Targets, baseline false alarms, flips, queries and moves of a search."""

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, F.lit(1)))

    flip = (F.col("baseline_margin") < 0) & (F.col("margin") >= 0) & F.col("success")
    agg = result.groupBy(*by).agg(
        F.count("*").alias("targeted_rows"),
        count(F.col("baseline_margin") >= 0).alias("baseline_false_alarm_rows"),
        count(F.col("success")).alias("attack_successes_any"),
        count(flip).alias("flip_rows"),
        F.avg(flip.cast("double")).alias("flip_rate"),
        F.avg((F.col("margin") >= 0).cast("double")).alias("attacked_pred_attack_rate"),
        F.sum("queries").alias("queries_total"),
        F.avg("queries").alias("queries_mean"),
        F.avg("moves").alias("accepted_moves_mean"),
    )
    return null_safe_join(agg, exact_quantiles(result, by, "queries", {"queries_p95": 0.95}), by)
