"""Class balance, drift, separability, outliers and capture statistics of a labelled table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.numeric import ratio
from flowlens.plans.quantiles import wide_quantiles
from flowlens.plans.small import null_safe_join, pinned


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def class_balance(df: DataFrame, *, label: str) -> DataFrame:
    counts = df.groupBy(F.when(F.col(label) == 1, F.lit("attack")).otherwise(F.lit("benign")).alias("label")).agg(
        F.count("*").alias("rows")
    )
    return counts.withColumn("share", ratio("rows", F.sum("rows").over(Window.partitionBy()), "max1"))


def label_balance(df: DataFrame, *, by: list[str], label: str) -> DataFrame:
    """Rows, benign and attack counts and shares per group; empty groups never appear."""
    counts = df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        _count_if(F.col(label) == 0).alias("benign_rows"),
        _count_if(F.col(label) == 1).alias("attack_rows"),
    )
    return counts.withColumns(
        {
            "benign_ratio": ratio("benign_rows", "rows", "max1"),
            "attack_ratio": ratio("attack_rows", "rows", "max1"),
        }
    )


def value_counts(df: DataFrame, *, col: str, top: int | None = None) -> DataFrame:
    """Counts and shares, most common first; ties in value order. ``top`` is the report size."""
    counts = df.groupBy(col).agg(F.count("*").alias("rows"))
    total = pinned(counts.agg(F.sum("rows").alias("total")))
    out = counts.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").drop("one")
    out = out.select(col, "rows", ratio("rows", "total", "max1").alias("share")).orderBy(F.col("rows").desc(), col)
    return out if top is None else out.limit(top)


def split_shift(df: DataFrame, *, col: str, split: str) -> DataFrame:
    """Train and test share of every value and their difference, largest change first."""
    counts = df.groupBy(col).agg(
        _count_if(F.col(split) == "train").alias("train_rows"), _count_if(F.col(split) == "test").alias("test_rows")
    )
    totals = pinned(counts.agg(F.sum("train_rows").alias("train_total"), F.sum("test_rows").alias("test_total")))
    out = counts.withColumn("one", F.lit(1)).join(totals.withColumn("one", F.lit(1)), "one")
    out = out.select(
        col,
        "train_rows",
        "test_rows",
        ratio("train_rows", "train_total", "max1").alias("train_share"),
        ratio("test_rows", "test_total", "max1").alias("test_share"),
    ).withColumn("share_diff_test_minus_train", F.col("test_share") - F.col("train_share"))
    return out.orderBy(F.abs("share_diff_test_minus_train").desc(), col)


def crosstab(df: DataFrame, *, rows: str, cols: str, top_rows: int, top_cols: int) -> DataFrame:
    """Counts of the most common row values against the most common column values, zeros kept."""
    counts = df.groupBy(rows, cols).agg(F.count("*").alias("n"))

    def top(name: str, k: int) -> DataFrame:
        return (
            counts.groupBy(name).agg(F.sum("n").alias("t")).orderBy(F.col("t").desc(), name).limit(k).select(name)
        )

    head = pinned(top(rows, top_rows).withColumn("one", F.lit(1)))
    side = pinned(top(cols, top_cols).withColumn("one", F.lit(1)))
    grid = head.join(side, "one").drop("one")
    return null_safe_join(grid, counts, [rows, cols], "left").fillna(0, ["n"])


def feature_separability(df: DataFrame, *, features: list[str], label: str, min_rows: int = 10) -> DataFrame:
    """Per feature: class means, population deviations, zero and missing rates, and Cohen's d.

    One wide aggregate reads the data once; only its single result row is turned into one row per feature.
    ``features`` may hold NULLs: they count as missing and enter the moments as 0.
    """
    aggs = []
    for i, f in enumerate(features):
        c = F.col(f"`{f}`")
        v = F.coalesce(c.cast("double"), F.lit(0.0))
        for k in (0, 1):
            mine = F.col(label) == k
            aggs += [
                _count_if(mine).alias(f"n{k}_{i}"),
                F.avg(F.when(mine, v)).alias(f"m{k}_{i}"),
                F.var_pop(F.when(mine, v)).alias(f"v{k}_{i}"),
                _count_if(mine & (v == 0.0)).alias(f"z{k}_{i}"),
                _count_if(mine & c.isNull()).alias(f"x{k}_{i}"),
            ]
    cells = [
        F.struct(
            F.lit(f).alias("feature"), *[F.col(f"{s}{k}_{i}").alias(f"{s}{k}") for s in "nmvzx" for k in (0, 1)]
        )
        for i, f in enumerate(features)
    ]
    long = df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = F.sqrt(((n0 - 1) * F.col("v0") + (n1 - 1) * F.col("v1")) / (n0 + n1 - 2))
    d = F.when((n0 >= 2) & (n1 >= 2) & (pooled > 0), (F.col("m1") - F.col("m0")) / pooled).otherwise(F.lit(0.0))
    out = long.where((n0 >= min_rows) & (n1 >= min_rows)).select(
        "feature",
        n0.alias("benign_n"),
        n1.alias("attack_n"),
        F.col("m0").alias("benign_mean"),
        F.col("m1").alias("attack_mean"),
        F.sqrt("v0").alias("benign_std"),
        F.sqrt("v1").alias("attack_std"),
        d.alias("cohens_d"),
        ratio("z0", n0, "max1").alias("benign_zero_rate"),
        ratio("z1", n1, "max1").alias("attack_zero_rate"),
        ratio("x0", n0, "max1").alias("benign_missing_rate"),
        ratio("x1", n1, "max1").alias("attack_missing_rate"),
    )
    return out.orderBy(F.abs("cohens_d").desc(), "feature")


def long_features(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """One row per (row, feature); only for work that needs every value, such as exact quantiles."""
    wide = df.select(*ids, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    return wide.unpivot(ids, [F.col(f"`{f}`") for f in features], "feature", "value")


def iqr_outliers(df: DataFrame, *, features: list[str], min_rows: int = 20, fence: float = 1.5) -> DataFrame:
    """Rows outside the interquartile fences per feature; constant and thin features are skipped.

    Fences come from quantiles of all columns at once, and one wide aggregate counts what is beyond them.
    """
    columns = {f: F.col(f"`{f}`").cast("double") for f in features}
    q = wide_quantiles(df, [], columns, {"q1": 0.25, "q3": 0.75}).withColumn("iqr", F.col("q3") - F.col("q1"))
    q = pinned(
        q.where((F.col("iqr") > 0) & (F.col("n") >= min_rows)).withColumns(
            {
                "lower_fence": F.col("q1") - F.lit(fence) * F.col("iqr"),
                "upper_fence": F.col("q3") + F.lit(fence) * F.col("iqr"),
            }
        )
    )
    fences = {r["feature"]: r for r in q.collect()}  # one row for each feature
    beyond = [
        _count_if((columns[f] < F.lit(r["lower_fence"])) | (columns[f] > F.lit(r["upper_fence"]))).alias(f"o{i}")
        for i, (f, r) in enumerate(fences.items())
    ]
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"o{i}").alias("outlier_count")) for i, f in enumerate(fences)]
    if not fences:
        return q.select("feature", "q1", "q3", "iqr", "lower_fence", "upper_fence", "n", F.col("n").alias("outlier_count"),
                        "min_value", "max_value", F.col("q1").alias("outlier_rate"))
    counts = df.agg(*beyond).select(F.inline(F.array(*cells)))
    out = q.join(counts, "feature").select(
        "feature", "q1", "q3", "iqr", "lower_fence", "upper_fence", "n", "outlier_count", "min_value", "max_value",
        ratio("outlier_count", "n", "max1").alias("outlier_rate"),
    )
    return out.orderBy(F.col("outlier_rate").desc(), F.col("outlier_count").desc(), "feature")


def feature_quantiles(df: DataFrame, *, features: list[str], label: str) -> DataFrame:
    """Deciles, quartiles and range per feature and class."""
    columns = {f: F.col(f"`{f}`").cast("double") for f in features}
    probs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    return wide_quantiles(df, [label], columns, probs).select("feature", label, *probs, "min_value", "max_value")


def correlation_matrix(df: DataFrame, *, features: list[str]) -> DataFrame:
    """Pearson correlation of every feature pair, one row per ordered pair, from one aggregate."""
    pairs = [(a, b) for a in features for b in features]
    aggs = [F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"r{i}") for i, (a, b) in enumerate(pairs) if a < b]
    index = {p: i for i, p in enumerate(pairs)}

    def cell(a: str, b: str) -> Column:
        r = F.lit(1.0) if a == b else F.col(f"r{index[(min(a, b), max(a, b))]}")
        return F.struct(F.lit(a).alias("feature_i"), F.lit(b).alias("feature_j"), r.alias("r"))

    return df.agg(*aggs).select(F.explode(F.array(*[cell(a, b) for a, b in pairs])).alias("c")).select("c.*")


def histogram(df: DataFrame, *, value: str, by: str, bins: int = 36) -> DataFrame:
    """Equal-width bins between each group's own minimum and maximum; the last bin is closed."""
    ends = pinned(df.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    raw = F.floor((F.col(value) - F.col("lo")) / width)
    bin_no = F.when(width <= 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))
    return (
        null_safe_join(df.where(F.col(value).isNotNull()), ends, [by])
        .groupBy(by, bin_no.cast("int").alias("bin"))
        .agg(F.count("*").alias("rows"))
    )


def capture_stats(df: DataFrame, *, strata: list[str], capture: str, is_val: str) -> DataFrame:
    """Rows, captures, largest capture share and validation rows per stratum.

    Rows collapse to captures first, so a capture holding a third of the data is a handful of partial sums.
    """
    per_capture = df.groupBy(*strata, capture).agg(
        F.count("*").alias("rows"), _count_if(F.col(is_val)).alias("val_rows")
    )
    out = per_capture.groupBy(*strata).agg(
        F.sum("rows").alias("rows"),
        F.count("*").alias("unique_files"),
        F.max("rows").alias("largest"),
        F.sum("val_rows").alias("val_rows"),
    )
    return out.withColumns(
        {"largest_file_share": ratio("largest", "rows"), "fpr_resolution": ratio(F.lit(1), "val_rows")}
    ).drop("largest")


def fpr_feasibility(stats: DataFrame, *, max_fpr: float, enabled: bool = True, val_rows: str = "val_rows") -> DataFrame:
    """Whether the validation benign rows can resolve the FPR limit: at least ceil(1 / max_fpr) of them."""
    required = max(1, math.ceil(1.0 / max_fpr)) if max_fpr > 0 else 1
    return stats.withColumns(
        {
            "min_required": F.lit(int(required)),
            "fpr_resolution": ratio(F.lit(1), val_rows),
            "strict_fpr_feasible": (F.col(val_rows) >= int(required)) if enabled else F.lit(True),
        }
    )


def standardizer(df: DataFrame, *, features: list[str], sample: bool = True) -> DataFrame:
    """Mean and deviation per feature; near-constant features get deviation 1."""
    spread, floor = (F.stddev_samp, 1e-12) if sample else (F.stddev_pop, 1e-6)
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.avg(F.col(f"`{f}`")).alias(f"m{i}"), spread(F.col(f"`{f}`")).alias(f"s{i}")]
    cells = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"m{i}").alias("mean"),
            F.when(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) <= floor, F.lit(1.0))
            .otherwise(F.col(f"s{i}"))
            .alias("std"),
        )
        for i, f in enumerate(features)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def apply_standardizer(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (F.col(f"`{f}`") - F.lit(m)) / F.lit(s) for f, (m, s) in stats.items()})


def class_weights(df: DataFrame, *, label: str, by: list[str]) -> DataFrame:
    """Balanced weight per class, and negatives per positive (1 without positives)."""
    c = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        _count_if(F.col(label) == 1).alias("n_pos"),
        _count_if(F.col(label) == 0).alias("n_neg"),
    )
    return c.withColumns(
        {
            "weight_benign": ratio("n", F.lit(2) * F.col("n_neg")),
            "weight_attack": ratio("n", F.lit(2) * F.col("n_pos")),
            "scale_pos_weight": F.coalesce(ratio("n_neg", "n_pos"), F.lit(1.0)),
        }
    )


def table_sizes(df: DataFrame, *, by: list[str], label: str) -> DataFrame:
    """Rows and the share of attacks of each part of a data set."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(label).alias("attack_ratio"))


def stratum_counts(df: DataFrame, *, strata: list[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count("*").alias("rows"))


def protocol_support(
    df: DataFrame, *, by: str, label: str, part: str, min_train: int = 2, min_val: int = 2, min_test: int = 1
) -> DataFrame:
    """Which groups have enough rows of both classes to be modelled, with the first reason when not.

    ``part`` holds train, val or test.
    """
    y, p = F.col(label), F.col(part)
    c = df.groupBy(by).agg(
        *[_count_if(p == s).alias(f"{s}_rows") for s in ("train", "val", "test")],
        *[_count_if((p == s) & (y == k)).alias(f"{s}_{k}") for s in ("train", "val") for k in (0, 1)],
    )
    reason = (
        F.when(F.col("train_rows") < min_train, F.lit("too_few_train_rows"))
        .when(F.col("val_rows") < min_val, F.lit("too_few_val_rows"))
        .when(F.col("test_rows") < min_test, F.lit("too_few_test_rows"))
        .when((F.col("train_0") == 0) | (F.col("train_1") == 0), F.lit("single_class_train"))
        .when((F.col("val_0") == 0) | (F.col("val_1") == 0), F.lit("single_class_val"))
        .otherwise(F.lit(""))
    )
    return c.select(by, "train_rows", "val_rows", "test_rows", reason.alias("skip_reason"))
