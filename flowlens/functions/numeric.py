"""Ratios, sigmoids, grids and array measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _c(col: Column | str | float) -> Column:
    if isinstance(col, str):
        return F.col(col)
    return col if isinstance(col, Column) else F.lit(float(col))


def ratio(num: Column | str, den: Column | str, policy: str = "null") -> Column:
    """``num / den`` where an empty denominator gives NULL (``null``), 0 (``zero``) or is raised to 1 (``max1``)."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    if policy == "max1":
        return n / F.greatest(d, F.lit(1.0))
    quotient = F.when(d != 0, n / d)
    if policy == "zero":
        return F.coalesce(quotient, F.lit(0.0))
    if policy == "null":
        return quotient
    raise ValueError(f"unknown ratio policy {policy!r}")


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return ratio(F.lit(1.0 + b2) * precision * recall, F.lit(b2) * precision + recall)


def sigmoid(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def stable_sigmoid(z: Column | str, bound: float = 40.0) -> Column:
    """The logistic function of ``z`` clipped to ``bound``; NaN gives NaN. ``z`` is bound once, as it may be costly."""

    def inside(v: Column) -> Column:
        return sigmoid(clip(v, -bound, bound))

    return inside(F.col(z)) if isinstance(z, str) else F.get(F.transform(F.array(z), inside), F.lit(0))


def clip(col: Column | str, low: Column | float, high: Column | float) -> Column:
    """Into ``[low, high]``; NaN stays NaN (Spark orders it above every number)."""
    c = _c(col)
    return F.when(F.isnan(c.cast("double")), c).otherwise(F.least(F.greatest(c, _c(low)), _c(high)))


def passes(score: Column | str, threshold: Column | str | float) -> Column:
    """Inclusive comparison of a score with a threshold: NaN passes none, NULL on either side gives NULL."""
    s = _c(score).cast("double")
    return ~F.isnan(s) & (s >= _c(threshold))


def placeable(score: Column | str) -> Column:
    """The score for a search among thresholds, with NaN below all of them."""
    s = _c(score).cast("double")
    return F.when(F.isnan(s), F.lit(float("-inf"))).otherwise(s)


def linear_term(weights: dict[str, float], bias: float = 0.0) -> Column:
    z = F.lit(float(bias))
    for name, w in weights.items():
        z = z + F.lit(float(w)) * F.col(f"`{name}`")
    return z


def linear_score(weights: dict[str, float], bias: float = 0.0) -> Column:
    return sigmoid(linear_term(weights, bias))


def log_uniform(unit: Column | str, low: float, high: float) -> Column:
    """Map a uniform [0, 1) column to a log-uniform value in [low, high)."""
    a, b = math.log(low), math.log(high)
    return F.exp(F.lit(a) + _c(unit) * F.lit(b - a))


def linspace(low: Column, high: Column, points: int) -> Column:
    """Ascending array of ``points`` evenly spaced values; the last one is exactly ``high``."""
    n = max(2, int(points))
    step = (high - low) / F.lit(float(n - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.when(i == n - 1, high).otherwise(low + i.cast("double") * step),
    )


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v * v))


def max_abs(a: Column | str) -> Column:
    return F.array_max(F.transform(_c(a), lambda v: F.abs(v)))


def count_above(a: Column | str, tol: float) -> Column:
    return F.size(F.filter(_c(a), lambda v: F.abs(v) > F.lit(tol)))


def harmonic_gap(lo: Column, hi: Column) -> Column:
    """``H(hi) - H(lo)`` for harmonic numbers of non-negative counts ``lo <= hi``, without summing the terms.

    Arguments below 32 are lifted by the recurrence H(n) = H(n + 32) - sum(1 / (n + i)); above that the asymptotic
    series is exact to double precision, and the logarithms are subtracted through log1p.
    """
    lo, hi = lo.cast("double"), hi.cast("double")

    def lifted(n: Column) -> tuple[Column, Column]:
        small = n < F.lit(32.0)
        terms = F.aggregate(
            F.sequence(F.lit(1), F.lit(32)), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / (n + i.cast("double"))
        )
        return F.when(small, n + F.lit(32.0)).otherwise(n), F.when(small, terms).otherwise(F.lit(0.0))

    def tail(n: Column) -> Column:
        sq = n * n
        return F.lit(0.5) / n - F.lit(1.0) / (F.lit(12.0) * sq) + F.lit(1.0) / (F.lit(120.0) * sq * sq)

    (a, da), (b, db) = lifted(lo), lifted(hi)
    return F.log1p((b - a) / a) + tail(b) - tail(a) - db + da
