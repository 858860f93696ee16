"""Exact quantiles of many columns at once: sketches bracket each quantile, a second look counts and keeps what is inside.

No value leaves its row but those between two bounds, so that nothing as long as rows times columns is dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.plans.ordered import SKETCH_GROUPS, SKETCH_K, exact_quantiles, running_totals
from flowlens.plans.small import null_safe_join, pinned

#: On both sides of a quantile's rank; about three times the error of a sketch of SKETCH_K.
MARGIN = 0.003


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def _bounds(df: DataFrame, by: list[str], columns: list[Column], probs: list[float]) -> DataFrame:
    """``(by..., lo<i>, hi<i>)``: for each column the arrays of lower and upper bounds of its quantiles, by group."""
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("__g")
    narrow = df.select(*by, group, *[_finite(c).alias(f"__x{i}") for i, c in enumerate(columns)])
    names = range(len(columns))
    parts = narrow.groupBy(*by, "__g").agg(*[F.kll_sketch_agg_double(f"__x{i}", F.lit(SKETCH_K)).alias(f"__s{i}") for i in names])
    whole = parts.groupBy(*by).agg(*[F.kll_merge_agg_double(f"__s{i}", F.lit(SKETCH_K)).alias(f"__s{i}") for i in names])

    def at(i: int, shift: float) -> Column:
        ranks = F.array(*[F.lit(min(1.0, max(0.0, p + shift))) for p in probs])
        got = F.kll_sketch_get_quantile_double(f"__s{i}", ranks)
        return F.when(F.kll_sketch_get_n_double(f"__s{i}") > 0, got)

    return pinned(
        whole.select(*by, *[at(i, -MARGIN).alias(f"lo{i}") for i in names], *[at(i, MARGIN).alias(f"hi{i}") for i in names])
    )


def wide_quantiles(
    df: DataFrame, by: list[str], columns: dict[str, Column], probs: dict[str, float], name: str = "feature"
) -> DataFrame:
    """``(by..., name, n, min_value, max_value, <probs>)``: exact linearly interpolated quantiles of each column in each group
    that has a value of it. NULL values are ignored, NaN counts as the largest.

    One look at the rows makes all sketches, one counts what is below each bracket, one brings the values inside, already
    counted in each task. Where a bracket misses (a sketch may err, NaN and infinities have no place in one), that column
    is ranked in full.
    """
    key, names, levels = "__all", list(columns), list(probs)
    scope = by or [key]
    values = [c.cast("double") for c in columns.values()]
    rows = df.select(*([F.col(b) for b in by] or [F.lit(0).alias(key)]), *[v.alias(f"__v{i}") for i, v in enumerate(values)])
    v = [F.col(f"__v{i}") for i in range(len(names))]
    bounds = _bounds(rows, scope, v, list(probs.values()))
    joined = null_safe_join(rows, bounds, scope)

    def lo(i: int, j: int) -> Column:
        return F.get(f"lo{i}", F.lit(j))

    def hi(i: int, j: int) -> Column:
        return F.get(f"hi{i}", F.lit(j))

    sums = []
    for i, x in enumerate(v):
        sums += [F.count(x).alias(f"n{i}"), F.count(_finite(x)).alias(f"f{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}")]
        sums += [F.count(F.when(x < lo(i, j), 1)).alias(f"b{i}_{j}") for j in range(len(levels))]
    cells = [
        F.struct(
            F.lit(c).alias(name), F.col(f"n{i}").alias("n"), F.col(f"f{i}").alias("finite"), F.col(f"a{i}").alias("min_value"),
            F.col(f"z{i}").alias("max_value"), F.array(*[F.col(f"b{i}_{j}") for j in range(len(levels))]).alias("below"),
            F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"),
        )
        for i, c in enumerate(names)
    ]
    counted = null_safe_join(joined.groupBy(*scope).agg(*sums), bounds, scope).select(*scope, F.inline(F.array(*cells)))
    counted = pinned(counted.where("n > 0"))
    inside = []
    for i, x in enumerate(v):
        held = F.lit(False)
        for j in range(len(levels)):
            held = held | ((x >= lo(i, j)) & (x <= hi(i, j)))
        inside.append(F.when(held, F.struct(F.lit(i).alias("i"), x.alias("value"))))
    kept = joined.select(*scope, F.inline(F.array_compact(F.array(*inside)))).groupBy(*scope, "i", "value").agg(F.count("*").alias("c"))
    label = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1).alias(name)
    kept = pinned(kept.select(*scope, label, "value", "c"))

    places = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p")) for j, p in enumerate(probs.values())])
    wanted = counted.select(*scope, name, "n", "finite", "below", "lo", "hi", F.inline(places))
    wanted = wanted.withColumn("pos", F.col("p") * (F.col("n") - 1).cast("double")).select(
        *scope, name, "j", "pos", (F.col("finite") == F.col("n")).alias("whole"),
        F.get("below", F.col("j")).alias("below"), F.get("lo", F.col("j")).alias("lo"), F.get("hi", F.col("j")).alias("hi"),
    )
    near = null_safe_join(kept, wanted, [*scope, name]).where("value between lo and hi")
    group = [*scope, name, "j"]
    if kept.isLocal():
        upto = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        near = near.withColumn("cum_c", F.sum("c").over(upto))
    else:
        near = running_totals(near, group, ["value"], {"c": "c"})
    seen = F.col("below") + F.col("cum_c")
    found = near.groupBy(*group).agg(
        F.min(F.when(seen > F.floor("pos"), F.col("value"))).alias("v_lo"),
        F.min(F.when(seen > F.ceil("pos"), F.col("value"))).alias("v_hi"),
        F.first("pos").alias("pos"),
        F.first(F.col("whole") & (F.col("below") <= F.floor("pos"))).alias("ok"),
    )
    part = F.col("pos") - F.floor("pos")
    got = F.when(F.col("ok"), F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * part)
    picks = [F.max(F.when(F.col("j") == j, got)).alias(c) for j, c in enumerate(levels)]
    spread = null_safe_join(counted, found.groupBy(*scope, name).agg(*picks), [*scope, name], "left")
    out = pinned(spread.select(*scope, name, "n", "min_value", "max_value", *levels))
    missed = out.where(" or ".join(f"`{c}` is null" for c in levels))
    again = [r[0] for r in missed.select(name).distinct().collect()]
    if again:
        long = rows.unpivot(scope, [F.col(f"__v{names.index(c)}").alias(c) for c in again], name, "value")
        full = exact_quantiles(long, [*scope, name], "value", probs)
        ends = out.where(F.col(name).isin(again)).drop(*levels)
        out = out.where(~F.col(name).isin(again)).unionByName(null_safe_join(ends, full, [*scope, name]).select(*out.columns))
    return out if by else out.drop(key)
