"""Places in an order in which groups take turns, worked out from the groups' sizes: no row is sorted for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.plans.ordered import array_position, rank_rows
from flowlens.plans.small import null_safe_join, pinned

#: Distinct sizes of the groups of one scope are fewer: their sum would be 2 ** 41 rows.
MAX_SIZES = (1 << 21) - 1


def group_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., size)``; what later levels need of the rows, from one aggregate."""
    return pinned(df.groupBy(*by).agg(F.count("*").alias("size")))


def turn_tables(sizes: DataFrame, scope: list[str], by: list[str], rotation: Sequence[Column], few: bool) -> DataFrame:
    """For each group of ``sizes (scope..., by..., size)`` arrays by which a turn becomes a place.

    Let d1 < d2 < ... be the distinct sizes in a scope. For turns after d(k-1) up to d(k) the same groups are left, so turn
    t of a group is at (rows of turns up to d(k-1)) + (t - 1 - d(k-1)) * (groups left) + (the group's rank among them). Each
    group has one entry for every distinct size up to its own: together no more than there are rows. With ``few`` groups,
    such as pinned ones, a window ranks those that are left; else ranks are spread over ranges.
    """
    at_least = Window.partitionBy(*scope).orderBy(F.col("upto").desc())
    before = Window.partitionBy(*scope).orderBy("upto")
    # distinct sizes of a scope are fewer than the square root of twice its rows
    classes = sizes.groupBy(*scope, F.col("size").alias("upto")).agg(F.count("*").alias("n"))
    classes = classes.withColumn("left", F.sum("n").over(at_least)).withColumn("after", F.coalesce(F.lag("upto").over(before), F.lit(0)))
    done = F.sum((F.col("upto") - F.col("after")) * F.col("left")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    classes = classes.withColumn("done", F.coalesce(done, F.lit(0))).drop("n")
    marked = sizes.withColumns({f"__r{i}": c for i, c in enumerate(rotation)})
    if scope:
        taking = null_safe_join(marked, classes, scope)
    else:
        taking = marked.withColumn("__one", F.lit(1)).join(classes.withColumn("__one", F.lit(1)), "__one").drop("__one")
    taking = taking.where(F.col("upto") <= F.col("size"))
    order = [F.col(f"__r{i}") for i in range(len(rotation))]
    if few:
        ranked = taking.withColumn("rank", F.row_number().over(Window.partitionBy(*scope, "upto").orderBy(*order)))
    else:
        ranked = rank_rows(taking, [*scope, "upto"], order, "rank")
    start = F.col("done") + F.col("rank") - F.col("left") * (F.col("after") + F.lit(1))
    entry = F.struct("upto", start.alias("start"), "left")
    return ranked.groupBy(*scope, *by).agg(F.array_sort(F.collect_list(entry)).alias("__turns"))


def place_in_turn(df: DataFrame, tables: DataFrame, keys: list[str], turn: str, name: str) -> DataFrame:
    """Add the place of each row, which is row ``turn`` (from 1) of its group."""
    joined = null_safe_join(df, tables, keys)
    k = array_position(F.col("__turns.upto"), F.col(turn), MAX_SIZES, inclusive=False)
    part = F.get("__turns", k)
    place = part["start"] + part["left"] * F.col(turn)
    return joined.withColumn(name, place.cast("bigint")).drop("__turns")
