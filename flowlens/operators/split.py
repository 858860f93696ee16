"""Leakage-safe validation splits, decided by hashes so that any partitioning of the data gives the same answer.

The row-level decision is a projection: strata are summarised to a few rows (mode and cut-off per stratum) that
travel to the data, instead of sorting the data inside each stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.hashing import row_hash
from flowlens.plans.ordered import order_cutoffs, running_totals
from flowlens.plans.small import null_safe_join, pinned


def hash_val_split_row(df: DataFrame, *, key: list[str], seed: int, mod: int = 5, name: str = "is_val") -> DataFrame:
    """Every row on its own: validation when the key hash falls in the first of ``mod`` classes."""
    return df.withColumn(name, F.pmod(row_hash(*key, seed=seed), F.lit(mod)) == 0)


def _val_target(n: Column, mod: int) -> Column:
    share = F.rint(n.cast("double") / F.lit(float(mod))).cast("bigint")
    return F.greatest(F.lit(1), F.least(n - F.lit(1), share))


def capture_val_split(
    df: DataFrame,
    *,
    strata: list[str],
    capture: str,
    row: str,
    seed: int,
    mod: int = 5,
    rebalance: str = "capture",
    allow_row_fallback: bool = True,
    name: str = "is_val",
) -> tuple[DataFrame, DataFrame]:
    """Whole captures go to train or validation within each stratum.

    A stratum whose captures all hash to one side falls back: ``rebalance='capture'`` takes round(files / mod)
    captures by a second hash, or rows when there is a single capture; ``rebalance='row'`` always takes rows.
    Strata of one row stay in train. Returns the marked data and the fallback events.
    """
    if mod <= 1:
        raise ValueError("mod must be at least 2")
    first = F.pmod(row_hash(capture, seed=seed), F.lit(mod)) == 0
    second = row_hash(capture, F.lit("rebalance"), seed=seed)
    row_key = row_hash(capture, row, F.lit("row"), seed=seed)

    captures = df.groupBy(*strata, capture).agg(F.count("*").alias("__rows"))
    info = captures.groupBy(*strata).agg(
        F.sum("__rows").alias("__n"),
        F.count("*").alias("__files"),
        F.count(F.when(first, F.lit(1))).alias("__val_files"),
    )
    collapsed = (F.col("__val_files") == 0) | (F.col("__val_files") == F.col("__files"))
    by_capture = (F.col("__files") >= 2) if rebalance == "capture" else F.lit(False)
    mode = (
        F.when(F.col("__n") <= 1, F.lit("train"))
        .when(~collapsed, F.lit("hash"))
        .when(by_capture, F.lit("file_level_rebalance"))
        .otherwise(F.lit("row_level_single_file"))
    )
    info = pinned(info.withColumn("__mode", mode))
    if not allow_row_fallback and info.where(F.col("__mode") == "row_level_single_file").limit(1).count():
        raise RuntimeError("a single-capture stratum cannot be split while the row fallback is off")

    def cutoffs(source: DataFrame, key: Column, which: str, size: str) -> DataFrame:
        wanted = info.where(F.col("__mode") == which).select(*strata, _val_target(F.col(size), mod).alias("target"))
        rows = null_safe_join(source, wanted.withColumnRenamed("target", "__t"), strata).drop("__t")
        rows = null_safe_join(source, wanted.withColumnRenamed("target", "__t"), strata).drop("__t")
        return order_cutoffs(rows, strata, [key], wanted).select(*strata, F.col("cutoff.__o0").alias("__cut"))

    modes = [r["__mode"] for r in info.select("__mode").distinct().collect()]
    cuts: DataFrame | None = None
    if "file_level_rebalance" in modes:
        cuts = cutoffs(captures, second, "file_level_rebalance", "__files")
    if "row_level_single_file" in modes:
        by_row = cutoffs(df, row_key, "row_level_single_file", "__n")
        cuts = by_row if cuts is None else cuts.unionByName(by_row)
    if cuts is None:
        plan = info.withColumn("__cut", F.lit(None).cast("bigint"))
    else:
        plan = null_safe_join(info, cuts, strata, "left")
    joined = null_safe_join(df, pinned(plan.select(*strata, "__mode", "__cut")), strata)
    decided = (
        F.when(F.col("__mode") == "hash", first)
        .when(F.col("__mode") == "file_level_rebalance", second <= F.col("__cut"))
        .when(F.col("__mode") == "row_level_single_file", row_key <= F.col("__cut"))
        .otherwise(F.lit(False))
    )
    marked = joined.withColumn(name, decided).drop("__mode", "__cut")
    fallbacks = info.where(F.col("__mode").isin("file_level_rebalance", "row_level_single_file"))
    after = marked.groupBy(*strata).agg(F.count(F.when(F.col(name), F.lit(1))).alias("val_rows_after_split"))
    events = null_safe_join(fallbacks, after, strata).select(
        *strata,
        F.col("__n").alias("stratum_rows"),
        F.col("__files").alias("stratum_files"),
        F.col("__mode").alias("fallback_type"),
        "val_rows_after_split",
        (F.col("__n") - F.col("val_rows_after_split")).alias("train_rows_after_split"),
    )
    return marked, events


def train_floor(
    df: DataFrame, *, stratum: Column, capture: str, row: str, floor: int, seed: int, is_val: str = "is_val"
) -> DataFrame:
    """Move validation rows of one stratum to train until it has ``floor`` train rows, keeping one in validation.

    Rows leave the largest validation capture first (ties by hash), and inside a capture in hash order. Only the
    stratum's validation rows are touched; every other row passes through unshuffled.
    """
    mine = df.where(stratum)
    counts = mine.agg(
        F.count(F.when(~F.col(is_val), F.lit(1))).alias("train"), F.count(F.when(F.col(is_val), F.lit(1))).alias("val")
    ).first()
    move = min(max(0, floor - counts["train"]), max(0, counts["val"] - 1))
    if move <= 0:
        return df
    row_key = row_hash(capture, row, F.lit("floor"), seed=seed)
    movable = mine.where(F.col(is_val))
    captures = movable.groupBy(capture).agg(F.count("*").alias("__rows"))
    cum = running_totals(captures, [], [-F.col("__rows"), row_hash(capture, seed=seed), F.col(capture)], {"n": "__rows"})
    before = F.col("cum_n") - F.col("__rows")
    plan = cum.where(before < move).select(capture, (F.lit(move) - before).alias("__take"), "__rows")
    partial = pinned(plan.where(F.col("__take") < F.col("__rows")).select(capture, F.col("__take").alias("target")))
    cut = order_cutoffs(
        null_safe_join(movable, partial, [capture]).drop("target"), [capture], [row_key, F.col(row)], partial
    ).select(capture, "cutoff")
    plan = null_safe_join(plan.select(capture, F.lit(True).alias("__hit")), cut, [capture], "left")
    own = F.struct(row_key.alias("__o0"), F.col(row).alias("__o1"))
    moved = F.col("__hit").isNotNull() & (F.col("cutoff").isNull() | (own <= F.col("cutoff")))
    touched = (
        null_safe_join(movable, plan, [capture], "left").withColumn(is_val, ~moved).drop("__hit", "cutoff")
    )
    untouched = df.where(~(F.coalesce(stratum, F.lit(False)) & F.coalesce(F.col(is_val), F.lit(False))))
    return untouched.unionByName(touched.select(*df.columns))


def train_floor_event(
    before: DataFrame, after: DataFrame, *, stratum: Column, floor: int, is_val: str = "is_val"
) -> DataFrame:
    """One row about ``train_floor``: the stratum's train and validation rows before and after, and how many moved."""

    def counts(df: DataFrame, when: str) -> DataFrame:
        mine = F.coalesce(stratum, F.lit(False))
        return df.agg(
            F.count(F.when(mine & ~F.col(is_val), F.lit(1))).alias(f"train_rows_{when}_floor"),
            F.count(F.when(mine & F.col(is_val), F.lit(1))).alias(f"val_rows_{when}_floor"),
            F.lit(1).alias("one"),
        )

    both = counts(before, "before").join(counts(after, "after"), "one").drop("one")
    moved = F.col("train_rows_after_floor") - F.col("train_rows_before_floor")
    return both.select(
        F.lit(floor).cast("long").alias("floor_target"), (moved > 0).alias("floor_applied"), "*", moved.alias("rows_moved")
    )


def shared_captures(left: DataFrame, right: DataFrame, *, capture: str) -> DataFrame:
    """Captures present on both sides; the leak check passes when there are none."""
    return left.select(capture).intersect(right.select(capture))


def capture_overlap(left: DataFrame, right: DataFrame, *, capture: str, show: int = 10) -> DataFrame:
    """One row: how many captures leak and the first few names in order."""
    shared = shared_captures(left, right, capture=capture)
    names = shared.orderBy(capture).limit(show).agg(F.array_join(F.array_sort(F.collect_list(capture)), ",").alias("x"))
    total = shared.agg(F.count("*").alias("overlap"))
    one = F.lit(1).alias("one")
    return (
        total.select("*", one)
        .join(names.select("*", one), "one")
        .select("overlap", F.col("x").alias("first_captures"), (F.col("overlap") == 0).alias("disjoint"))
    )
