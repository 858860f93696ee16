"""Per-protocol feature bounds, locks, ratio bands, and the checks and projections built on them.

A profile is a small table with one row per protocol and one array per property, in feature order. Joined to the
rows, every check is arithmetic inside the row.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.coerce import is_finite
from flowlens.operators.profile import long_features
from flowlens.plans.ordered import exact_quantiles
from flowlens.plans.quantiles import wide_quantiles
from flowlens.plans.small import null_safe_join, once_per_row, pinned

ROLES = ("min", "avg", "max", "tot_sum", "number", "srate", "drate", "rate")


def feature_constraints(
    df: DataFrame,
    *,
    by: str,
    features: list[str],
    low: float = 0.01,
    high: float = 0.99,
    semantic_locks: list[str] | None = None,
    max_levels: int = 20,
) -> DataFrame:
    """Bounds from percentiles (never below 0), and locks for named or low-cardinality 0..1 features."""
    long = long_features(df, [by], features).where(is_finite("value"))
    keys = [by, "feature"]
    finite = {f: F.when(is_finite(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")) for f in features}
    q = wide_quantiles(df, [by], finite, {"p_low": low, "p_high": high})
    q = q.withColumnsRenamed({"min_value": "raw_min", "max_value": "raw_max"}).drop("n")
    level = F.bround("value", 6)
    levels = long.groupBy(*keys, level.alias("level")).agg(F.count("*").alias("c"))
    shape = levels.groupBy(*keys).agg(
        F.sum("c").alias("rows"),
        F.count("*").alias("unique_count"),
        F.min("level").alias("lo_level"),
        F.max("level").alias("hi_level"),
    )
    j = null_safe_join(q, shape, keys)
    semantic = F.col("feature").isin(semantic_locks) if semantic_locks else F.lit(False)
    auto = (F.col("unique_count") <= max_levels) & (F.col("lo_level") >= -1e-8) & (F.col("hi_level") <= 1.0 + 1e-8)
    lower = F.greatest(F.lit(0.0), F.col("p_low"))
    upper = F.greatest(lower, F.col("p_high"))
    reason = F.concat_ws(
        "|", F.when(semantic, F.lit("semantic")), F.when(auto, F.lit("auto_low_cardinality"))
    )
    return j.select(
        by,
        "feature",
        lower.alias("lower"),
        upper.alias("upper"),
        F.greatest(upper - lower, F.lit(1e-12)).alias("span"),
        (semantic | auto).alias("locked"),
        reason.alias("lock_reason"),
        "rows",
        "raw_min",
        "raw_max",
        "p_low",
        "p_high",
        "unique_count",
    )


def quantile_band(
    df: DataFrame, *, by: list[str], value: str, low: float, high: float, nonnegative: bool = False
) -> DataFrame:
    """The central band of the finite values, widened by 5 % of its width."""
    ok = df.where(is_finite(value))
    q = exact_quantiles(ok, by, value, {"q_low": low, "q_high": high})
    n = ok.groupBy(*by).agg(F.count("*").alias("n"))
    width = F.greatest(F.col("q_high") - F.col("q_low"), F.lit(1e-9))
    pad = F.lit(0.05) * width + F.lit(1e-9)
    floor = F.col("q_low") - pad
    return null_safe_join(q, n, by).select(
        *by,
        (F.greatest(F.lit(0.0), floor) if nonnegative else floor).alias("band_low"),
        (F.col("q_high") + pad).alias("band_high"),
        "n",
    )


def relation_profile(df: DataFrame, *, by: str, roles: dict[str, str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Bands of total / (number * average) and (source + destination rate) / rate, one row per protocol and ratio."""
    c = {r: F.col(f"`{roles[r]}`") for r in roles}
    parts = []
    if {"tot_sum", "number", "avg"} <= set(roles):
        den = c["number"] * c["avg"]
        parts.append(F.struct(F.lit("tot_num_avg").alias("relation"), F.when(den > 1e-9, c["tot_sum"] / den).alias("r")))
    if {"srate", "drate", "rate"} <= set(roles):
        parts.append(
            F.struct(
                F.lit("rate_ratio").alias("relation"),
                F.when(c["rate"] > 1e-9, (c["srate"] + c["drate"]) / c["rate"]).alias("r"),
            )
        )
    long = df.select(by, F.explode(F.array(*parts)).alias("p")).select(by, "p.*")
    return quantile_band(long, by=[by, "relation"], value="r", low=low, high=high, nonnegative=True)


# Name parts that put a feature into a cap group.
RATE_TOKENS = ["rate"]
SIZE_TOKENS = ["byte", "packet", "count", "number", "size", "tot", "sum", "len", "volume"]
TIME_TOKENS = ["time", "dur", "iat", "interval", "latency"]


def relative_caps(
    features: list[str],
    *,
    default: float,
    rate: float | None = None,
    size: float | None = None,
    time: float | None = None,
) -> dict[str, float]:
    """Largest relative change allowed per feature: the smallest cap of the groups its name belongs to."""
    out = {}
    for f in features:
        key = re.sub(r"[^0-9a-z]", "", f.lower())
        caps = [max(0.0, default)]
        for tokens, cap in ((RATE_TOKENS, rate), (SIZE_TOKENS, size), (TIME_TOKENS, time)):
            if cap is not None and any(t in key for t in tokens):
                caps.append(max(0.0, cap))
        out[f] = min(caps)
    return out


def relative_caps_table(features: DataFrame, *, feature: str, default: float, rate: float, size: float, time: float) -> DataFrame:
    """The same rule over a column of feature names."""
    key = F.regexp_replace(F.lower(F.col(feature)), r"[^\p{L}\p{N}]", "")

    def capped(tokens: list[str], cap: float) -> Column:
        hit = F.lit(False)
        for t in tokens:
            hit = hit | key.contains(t)
        return F.when(hit, F.lit(cap)).otherwise(F.lit(default))

    cap = F.least(F.lit(default), capped(RATE_TOKENS, rate), capped(SIZE_TOKENS, size), capped(TIME_TOKENS, time))
    return features.withColumn("relative_cap", F.greatest(F.lit(0.0), cap))


def profile_arrays(
    constraints: DataFrame, *, by: str, features: list[str], caps: dict[str, float], bands: DataFrame | None = None
) -> DataFrame:
    """One row per protocol with ``p_lower, p_upper, p_span, p_locked, p_cap`` arrays and the ratio bands."""

    def cell(f: str, value: str) -> Column:
        return F.max(F.when(F.col("feature") == f, F.col(value)))

    out = constraints.groupBy(by).agg(
        F.array(*[cell(f, "lower") for f in features]).alias("p_lower"),
        F.array(*[cell(f, "upper") for f in features]).alias("p_upper"),
        F.array(*[cell(f, "span") for f in features]).alias("p_span"),
        F.array(*[F.coalesce(cell(f, "locked"), F.lit(True)) for f in features]).alias("p_locked"),
    )
    out = out.withColumn("p_cap", F.array(*[F.lit(float(caps[f])) for f in features]))
    if bands is None:
        return out
    ends = []
    for rel in ("tot_num_avg", "rate_ratio"):
        for end in ("band_low", "band_high"):
            ends.append(F.max(F.when(F.col("relation") == rel, F.col(end))).alias(f"{rel}_{end}"))
    return null_safe_join(out, bands.groupBy(by).agg(*ends), [by], "left")


def attach_profile(df: DataFrame, profile: DataFrame, *, by: str) -> DataFrame:
    """Add the protocol's profile; a row of a protocol without one stays, with every feature locked."""
    profile = pinned(profile)
    width = profile.agg(F.max(F.size("p_locked"))).first()[0] or 0
    out = null_safe_join(df, profile, [by], "left")
    # an expression of its own would be evaluated again for every element that asks for its lock
    return once_per_row(out, {"p_locked": F.coalesce("p_locked", F.array_repeat(F.lit(True), width))})


def let(x: Column, fn) -> Column:
    """Bind a value inside a row, so that later steps refer to it without repeating its expression."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def let2(x: Column, y: Column, fn) -> Column:
    """Bind two values inside a row."""
    return let(F.struct(x.alias("a"), y.alias("b")), lambda s: fn(s["a"], s["b"]))


def vector(features: list[str]) -> Column:
    return F.array(*[F.col(f"`{f}`").cast("double") for f in features])


def spread(df: DataFrame, arr: str, features: list[str], prefix: str = "") -> DataFrame:
    """Array back to one column per feature."""
    return df.withColumns({f"{prefix}{f}": F.get(F.col(arr), F.lit(i)) for i, f in enumerate(features)})


def each(n: int, fn) -> Column:
    """Build an array of ``n`` values from an index column."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), fn)


def max_delta(x0: Column, n: int, eps: Column | float) -> Column:
    """Largest allowed move per feature: eps * span, limited by the relative cap, 0 when locked. ``x0`` must be a stored column."""
    e = eps if isinstance(eps, Column) else F.lit(float(max(0.0, eps)))

    def one(i: Column) -> Column:
        limit = F.least(e * F.get("p_span", i), F.get("p_cap", i) * F.greatest(F.abs(F.get(x0, i)), F.lit(1.0)))
        return F.when(F.get("p_locked", i), F.lit(0.0)).otherwise(limit)

    return F.array(*[one(F.lit(i)) for i in range(n)])


def _inside(v: Column, i: Column) -> Column:
    return F.least(F.greatest(F.get(v, i), F.get("p_lower", i)), F.get("p_upper", i))


def project_bounds(x: Column, x0: Column, n: int) -> Column:
    """Clip to the bounds; locked features return to their original value."""
    return let2(
        x, x0, lambda v, o: each(n, lambda i: F.when(F.get("p_locked", i), F.get(o, i)).otherwise(_inside(v, i)))
    )


def clipped(value: Column, i: int, x0: Column, cap: Column) -> Column:
    """Clip feature ``i`` to its bounds, then to ``x0 +- cap``; a locked one stays. ``x0`` and ``cap`` must be stored columns."""
    at = F.lit(i)
    inside = F.least(F.greatest(value, F.get("p_lower", at)), F.get("p_upper", at))
    move = F.least(F.greatest(inside - F.get(x0, at), -F.get(cap, at)), F.get(cap, at))
    return F.when(F.get("p_locked", at), F.get(x0, at)).otherwise(F.get(x0, at) + move)


def relation_flags(x: Column | list[Column], index: dict[str, int], tol: float = 1e-6) -> dict[str, Column]:
    """Which relations a feature vector breaks; ``index`` maps roles to positions."""
    g = {r: x[i] if isinstance(x, list) else F.get(x, F.lit(i)) for r, i in index.items()}
    no = F.lit(False)
    flags = {"min_avg_max": no, "tot_num_avg": no, "rate_ratio": no}
    if {"min", "avg", "max"} <= set(index):
        flags["min_avg_max"] = (g["avg"] < g["min"] - tol) | (g["avg"] > g["max"] + tol)

    def band(num: Column, den: Column, name: str) -> Column:
        r = num / den
        out = (r < F.col(f"{name}_band_low") - tol) | (r > F.col(f"{name}_band_high") + tol)
        return F.coalesce(F.when(den > 1e-9, out), no)

    if {"tot_sum", "number", "avg"} <= set(index):
        flags["tot_num_avg"] = band(g["tot_sum"], g["number"] * g["avg"], "tot_num_avg")
    if {"srate", "drate", "rate"} <= set(index):
        flags["rate_ratio"] = band(g["srate"] + g["drate"], g["rate"], "rate_ratio")
    flags["any"] = flags["min_avg_max"] | flags["tot_num_avg"] | flags["rate_ratio"]
    return flags


def _repairs(v: list[Column], free: list[Column], index: dict[str, int]) -> list:
    """The repair steps in order; each maps the current values to the changed ones by position."""

    def uncross(v: list[Column]) -> dict[int, Column]:
        lo, hi = v[index["min"]], v[index["max"]]
        f_lo, f_hi = free[index["min"]], free[index["max"]]
        mid = F.lit(0.5) * (lo + hi)
        return {
            index["min"]: F.when(lo <= hi, lo).when(f_lo & f_hi, mid).when(f_lo, hi).otherwise(lo),
            index["max"]: F.when(lo <= hi, hi).when(f_lo & f_hi, mid).when(~f_lo & f_hi, lo).otherwise(hi),
        }

    def between(v: list[Column]) -> dict[int, Column]:
        lo, av, hi = (v[index[r]] for r in ("min", "avg", "max"))
        f_lo, f_av, f_hi = (free[index[r]] for r in ("min", "avg", "max"))
        under, over = av < lo, (av >= lo) & (av > hi)
        return {
            index["avg"]: F.when(under & f_av, lo).when(over & f_av, hi).otherwise(av),
            index["min"]: F.when(under & ~f_av & f_lo, av).otherwise(lo),
            index["max"]: F.when(over & ~f_av & f_hi, av).otherwise(hi),
        }

    def total_ratio(v: list[Column]) -> dict[int, Column]:
        tot, num, av = (v[index[r]] for r in ("tot_sum", "number", "avg"))
        f_tot, f_num, f_av = (free[index[r]] for r in ("tot_sum", "number", "avg"))
        den, low = num * av, F.col("tot_num_avg_band_low")
        goal = F.least(F.greatest(tot / den, low), F.col("tot_num_avg_band_high"))
        on = (den > 1e-9) & low.isNotNull()
        by_avg = f_av & (num > 1e-9)
        by_num = ~by_avg & f_num & (av > 1e-9)
        return {
            index["tot_sum"]: F.when(on & f_tot, goal * den).otherwise(tot),
            index["avg"]: F.when(on & ~f_tot & by_avg, tot / (num * goal)).otherwise(av),
            index["number"]: F.when(on & ~f_tot & by_num, tot / (av * goal)).otherwise(num),
        }

    def rate_ratio(v: list[Column]) -> dict[int, Column]:
        s, d, r = (v[index[x]] for x in ("srate", "drate", "rate"))
        both = free[index["srate"]] & free[index["drate"]]
        num, low = s + d, F.col("rate_ratio_band_low")
        goal = F.least(F.greatest(num / r, low), F.col("rate_ratio_band_high"))
        on = (r > 1e-9) & low.isNotNull()
        even, scale = F.lit(0.5) * goal * r, goal * r / num
        return {
            index["srate"]: F.when(on & both & (num <= 1e-12), even).when(on & both, s * scale).otherwise(s),
            index["drate"]: F.when(on & both & (num <= 1e-12), even).when(on & both, d * scale).otherwise(d),
            index["rate"]: F.when(on & ~both & free[index["rate"]] & (goal > 1e-12), num / goal).otherwise(r),
        }

    steps = []
    if {"min", "avg", "max"} <= set(index):
        steps += [uncross, between]
    if {"tot_sum", "number", "avg"} <= set(index):
        steps.append(total_ratio)
    if {"srate", "drate", "rate"} <= set(index):
        steps.append(rate_ratio)
    return steps


def satisfies(x: Column, x0: Column, cap: Column, index: dict[str, int], n: int, tol: float = 1e-6) -> Column:
    """Inside bounds, caps, locks and relations. ``cap`` must be a stored column."""

    def good(x: Column, x0: Column) -> Column:
        def ok(i: Column) -> Column:
            v, o = F.get(x, i), F.get(x0, i)
            return (
                (v >= F.get("p_lower", i) - tol)
                & (v <= F.get("p_upper", i) + tol)
                & (F.abs(v - o) <= F.get(cap, i) + tol)
            )

        return F.forall(F.sequence(F.lit(0), F.lit(n - 1)), ok) & ~relation_flags(x, index, tol)["any"]

    return let2(x, x0, good)


def project_row(
    df: DataFrame, *, candidate: str, original: str, reference: str, index: dict[str, int], n: int, eps: float,
    out: str = "projected", rounds: int = 4,
) -> DataFrame:
    """Full projection: clip, repair for a few rounds changing only unlocked features, and fall back to the last valid
    point, then to the original.

    Values are plain columns while they are repaired, stored once per step, so the plan grows linearly in the rounds.
    """
    x0 = F.col(original)
    at = lambda arr, i: F.get(F.col(arr) if isinstance(arr, str) else arr, F.lit(i))
    orig = [F.col(f"__o{i}") for i in range(n)]
    cap = [F.col(f"__c{i}") for i in range(n)]
    value = [F.col(f"__v{i}") for i in range(n)]
    locked = [at("p_locked", i) for i in range(n)]
    free = [~c for c in locked]

    def allowance(i: int) -> Column:
        limit = F.least(F.lit(eps) * at("p_span", i), at("p_cap", i) * F.greatest(F.abs(at(x0, i)), F.lit(1.0)))
        return F.when(locked[i], F.lit(0.0)).otherwise(limit)

    def clipped(v: Column, i: int) -> Column:
        inside = F.least(F.greatest(v, at("p_lower", i)), at("p_upper", i))
        move = F.least(F.greatest(inside - orig[i], -cap[i]), cap[i])
        return F.when(locked[i], orig[i]).otherwise(orig[i] + move)

    df = once_per_row(
        df, {**{f"__o{i}": at(x0, i) for i in range(n)}, **{f"__c{i}": allowance(i) for i in range(n)}}
    )
    df = once_per_row(df, {f"__v{i}": clipped(at(candidate, i), i) for i in range(n)})
    repairs = _repairs(value, free, index)
    for _ in range(rounds if repairs else 0):  # a clipped point stays where it is when it is clipped again
        for step in repairs:
            df = once_per_row(df, {f"__v{i}": c for i, c in step(value).items()})
        df = once_per_row(df, {f"__v{i}": clipped(value[i], i) for i in range(n)})

    def valid(v: list[Column], tol: float = 1e-6) -> Column:
        ok = ~relation_flags(v, index, tol)["any"]
        for i in range(n):
            ok = ok & (v[i] >= at("p_lower", i) - tol) & (v[i] <= at("p_upper", i) + tol)
            ok = ok & (F.abs(v[i] - orig[i]) <= cap[i] + tol)
        return ok

    for name, point in {"__valid": value, "__kept": [at(reference, i) for i in range(n)]}.items():
        df = once_per_row(df, {name: valid(point)})
    chosen = F.when(F.col("__valid"), F.array(*value)).when(F.col("__kept"), F.col(reference)).otherwise(x0)
    df = once_per_row(df, {out: chosen})
    return df.drop("__valid", "__kept", *[f"__{k}{i}" for k in "ocv" for i in range(n)])


def violation_summary(
    df: DataFrame, *, x: str, x0: str, index: dict[str, int], n: int, eps: float, by: list[str]
) -> DataFrame:
    """How many cells or rows break each kind of constraint."""
    a, o = F.col(x), F.col(x0)
    cap = max_delta(o, n, eps)
    flags = relation_flags(a, index)
    value = [F.get(a, F.lit(i)) for i in range(n)]
    move = [F.abs(value[i] - F.get(o, F.lit(i))) for i in range(n)]
    locked = [F.get("p_locked", F.lit(i)) for i in range(n)]
    locked_move = F.array_max(F.array(*[F.when(locked[i], move[i]).otherwise(F.lit(0.0)) for i in range(n)]))
    over_cap = F.array_max(F.array(*[move[i] - F.get("__cap", F.lit(i)) for i in range(n)]))

    def cells(cond: Callable[[int], Column]) -> Column:
        return reduce(operator.add, [F.when(~locked[i] & cond(i), 1).otherwise(0) for i in range(n)])

    below = cells(lambda i: value[i] < F.get("p_lower", F.lit(i)) - 1e-6)
    above = cells(lambda i: value[i] > F.get("p_upper", F.lit(i)) + 1e-6)
    rows = once_per_row(df, {"__cap": cap})
    # stored one by one: all of them in one aggregate make a method too long to be compiled to machine code
    for name, c in {"__below": below, "__above": above, "__locked_move": locked_move, "__over_cap": over_cap, "__flags": F.struct(
        *[c.alias(k) for k, c in flags.items()])}.items():
        rows = once_per_row(rows, {name: c})

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, F.lit(1)))

    return rows.groupBy(*by).agg(
        F.sum("__below").alias("below_lower_violations"),
        F.sum("__above").alias("above_upper_violations"),
        count(F.col("__locked_move") > 1e-9).alias("locked_change_rows"),
        F.max("__locked_move").alias("locked_change_max_abs"),
        count(F.col("__over_cap") > 1e-2).alias("cap_violation_rows"),
        count(F.col("__flags.any")).alias("relation_violation_rows"),
        count(F.col("__flags.min_avg_max")).alias("relation_min_avg_max_rows"),
        count(F.col("__flags.tot_num_avg")).alias("relation_tot_num_avg_rows"),
        count(F.col("__flags.rate_ratio")).alias("relation_rate_rows"),
    )


INTEGRITY = ["below_lower_violations", "above_upper_violations", "locked_change_rows", "relation_violation_rows"]


def integrity(
    df: DataFrame, *, x: str, x0: str, index: dict[str, int], n: int, eps: float, by: list[str], queries: str | None = None
) -> DataFrame:
    """``violation_summary`` of the rows that were moved, with their number and the most queries one row made."""
    a, o = F.col(x), F.col(x0)
    moved = F.array_max(F.array(*[F.abs(F.get(a, F.lit(i)) - F.get(o, F.lit(i))) for i in range(n)])) > 1e-9
    rows = violation_summary(df.where(moved), x=x, x0=x0, index=index, n=n, eps=eps, by=by)
    most = F.max(queries) if queries else F.lit(None).cast("int")
    every = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count(F.when(moved, F.lit(1))).alias("changed_rows"), most.alias("max_queries"))
    counted = [c for c in rows.columns if c.endswith("violations") or c.endswith("_rows")]
    return null_safe_join(every, rows, by, "left").fillna(0, counted)


def assert_integrity(summary: DataFrame, *, budget: int | None = None) -> None:
    """Raise when a moved row leaves its bounds, moves a locked feature or breaks a relation, or when a row made more
    queries than its budget; reads one aggregate row per group."""
    broken = F.lit(False)
    for c in INTEGRITY:
        broken = broken | (F.col(c) > 0)
    if budget is not None:
        broken = broken | F.coalesce(F.col("max_queries") > budget, F.lit(False))
    bad = summary.where(broken).limit(1).collect()
    if bad:
        raise AssertionError(f"constraint integrity: {bad[0].asDict()}")
