"""Comparison joins and set operations between small reports and between flow tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.plans.ordered import best_row
from flowlens.plans.small import null_safe_join, pinned


def merge_fill(left: DataFrame, right: DataFrame, *, on: list[str], fill: dict[str, float]) -> DataFrame:
    """Left join with the unmatched numbers filled."""
    return null_safe_join(left, right, on, "left").fillna(fill)


def drop_overlap(df: DataFrame, base: DataFrame, *, key: list[str]) -> DataFrame:
    """Rows whose identity is not in ``base``."""
    return df.join(base.select(*key), key, "left_anti")


def baseline_delta(df: DataFrame, *, scope: list[str], is_baseline: Column, measures: list[str]) -> DataFrame:
    """Difference of every measure to the baseline row of its scope."""
    base = pinned(df.where(is_baseline).select(*scope, *[F.col(m).alias(f"__b_{m}") for m in measures]))
    j = null_safe_join(df, base, scope, "left")
    return j.withColumns({f"delta_{m}": F.col(m) - F.col(f"__b_{m}") for m in measures}).drop(
        *[f"__b_{m}" for m in measures]
    )


def policy_compare(
    df: DataFrame, *, key: list[str], policy: str, before: str, after: str, measures: list[str]
) -> DataFrame:
    """Two policies side by side per key with deltas, by conditional aggregation over the two known policies."""
    aggs = []
    for m in measures:
        aggs += [
            F.max(F.when(F.col(policy) == before, F.col(m))).alias(f"{m}_before"),
            F.max(F.when(F.col(policy) == after, F.col(m))).alias(f"{m}_after"),
        ]
    out = df.where(F.col(policy).isin(before, after)).groupBy(*key).agg(*aggs)
    return out.withColumns({f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in measures})


def gather_profile(df: DataFrame, profile: DataFrame, *, on: str, feature: str, values: list[str]) -> DataFrame:
    """Attach a protocol's per-feature profile to its rows as one map column per value."""
    maps = profile.groupBy(on).agg(
        *[F.map_from_entries(F.collect_list(F.struct(F.col(feature), F.col(v)))).alias(f"{v}_by_feature") for v in values]
    )
    return null_safe_join(df, pinned(maps), [on], "left")


def lookup_name(df: DataFrame, names: DataFrame, *, on: str, name: str, default: str = "unknown") -> DataFrame:
    return null_safe_join(df, names.select(on, name), [on], "left").withColumn(name, F.coalesce(name, F.lit(default)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_keep(df: DataFrame, *, key: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row per key: the first or the last in an explicit order (``dropDuplicates`` keeps an arbitrary one)."""
    return best_row(df, key, [c.desc() for c in order] if last else order)


def where_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column holds one of a few values; pushed down to the scan."""
    return df.where(F.col(column).isin(values))


def where_near(df: DataFrame, column: str, value: float, tolerance: float = 1e-12) -> DataFrame:
    """Rows whose column is within a tolerance of a value; NULL and NaN are not."""
    return df.where(F.abs(F.col(column) - F.lit(value)) <= F.lit(tolerance))


def benign_rows(df: DataFrame, *, label: str, protocol: str, protocols: list[str]) -> DataFrame:
    return where_in(df.where(F.col(label) == 0), protocol, protocols)


def attach_predictions(df: DataFrame, predictions: DataFrame, *, key: list[str]) -> DataFrame:
    """Add the columns of ``predictions`` by key; rows without one get NULLs. A key that has two predictions is an error."""
    twice = predictions.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one prediction for {twice[0].asDict()}")
    return null_safe_join(df, predictions, key, "left")


def select_not_in(df: DataFrame, chosen: DataFrame, *, key: list[str]) -> DataFrame:
    return df.join(chosen.select(*key), key, "left_anti")


def weighted_union(
    base: DataFrame, hard_benign: DataFrame, hard_attack: DataFrame, *, label: str, w_benign: float, w_attack: float
) -> DataFrame:
    """Training rows plus hard examples: base weight 1, hard negatives label 0, adversarial attacks label 1."""
    return (
        base.withColumns({"weight": F.lit(1.0), "origin": F.lit("base")})
        .unionByName(
            hard_benign.withColumns({label: F.lit(0), "weight": F.lit(w_benign), "origin": F.lit("hard_negative")})
        )
        .unionByName(
            hard_attack.withColumns({label: F.lit(1), "weight": F.lit(w_attack), "origin": F.lit("adversarial")})
        )
    )


def sort_by(df: DataFrame, *, order: list[tuple[str, bool]], n: int | None = None) -> DataFrame:
    """Mixed-direction sort, NULL and NaN last in every key; ``n`` turns it into a top-n."""
    keys = []
    for name, asc in order:
        c = F.col(name)
        if dict(df.dtypes)[name] in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        keys.append(c.asc_nulls_last() if asc else c.desc_nulls_last())
    out = df.orderBy(*keys)
    return out if n is None else out.limit(n)


def sort_by_abs(df: DataFrame, *, col: str, tie: list[str], n: int | None = None) -> DataFrame:
    out = df.orderBy(F.abs(col).desc_nulls_last(), *tie)
    return out if n is None else out.limit(n)


def rank_features(df: DataFrame, *, by: str, primary: str, secondary: str, feature: str = "feature") -> DataFrame:
    """1..n per group by two descending keys; groups hold one row per feature."""
    w = Window.partitionBy(by).orderBy(F.col(primary).desc(), F.col(secondary).desc(), F.col(feature))
    return df.withColumn("rank", F.row_number().over(w))
