"""Ordered computations without a single-task sort.

``Window.partitionBy(scope).orderBy(x)`` sends a whole scope to one task, which fails when one scope holds a third
of the data. Everything here works in two levels instead: rows are cut into ranges of the leading sort key, per-range
totals (a table of ``scopes x ranges`` rows) are accumulated, and the window only runs inside a range. The cut points
come from a mergeable quantile sketch, so ranges carry similar row counts whatever the distribution; any cut points
give the same result, they only decide balance. Tables below ``spark.flowlens.rowsPerBin`` rows use one range.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from flowlens.plans.small import null_safe_join, pinned

ROWS_PER_BIN = 1_000_000
MAX_BINS = 1 << 14
SKETCH_K = 4096
SKETCH_GROUPS = 64
HOT_RANGES = 4


def _rows_per_bin(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.flowlens.rowsPerBin", str(ROWS_PER_BIN)))


def array_position(sorted_values: Column, x: Column, size: int, inclusive: bool) -> Column:
    """How many entries of an ascending array are ``< x`` (``<= x`` when inclusive): a binary search in the row."""
    steps, step = [], 1
    while step <= size:
        steps.append(step)
        step *= 2

    def jump(pos: Column, width: Column) -> Column:
        entry = F.get(sorted_values, pos + width - F.lit(1))
        hit = entry <= x if inclusive else entry < x
        return F.when(hit, pos + width).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), jump)


def _quantiles(df: DataFrame, by_row: DataFrame) -> dict[object, list[float]]:
    """Quantile lists of ``(v, g, x)`` rows per ``v``: as many as the row count calls for, none for a small group.

    One narrow scan builds a sketch per group of input partitions, so no task merges more than its share; only one
    sketch per ``v`` comes back.
    """
    sketch = F.kll_sketch_agg_double(
        F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x")), F.lit(SKETCH_K)
    )
    parts = by_row.groupBy("v", "g").agg(F.count("*").alias("n"), sketch.alias("s"))
    merged = parts.groupBy("v").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("s", F.lit(SKETCH_K)).alias("s"))
    out = {}
    for row in merged.collect():
        want = -(-row["n"] // _rows_per_bin(df))
        if want <= 1 or row["s"] is None:
            continue
        bins = 2
        while bins < want and bins < MAX_BINS:
            bins *= 2
        ranks = F.from_json(F.lit(json.dumps([i / bins for i in range(1, bins)])), "array<double>")
        got = (
            df.sparkSession.createDataFrame([(row["s"],)], "s binary")
            .where(F.kll_sketch_get_n_double("s") > 0)
            .select(F.kll_sketch_get_quantile_double("s", ranks).alias("q"))
            .first()
        )
        if got:
            out[row["v"]] = sorted(got["q"])
    return out


def _literal(values: list) -> Column:
    kind = "array<array<double>>" if values and isinstance(values[0], list) else "array<double>"
    return F.from_json(F.lit(json.dumps(values)), kind)


def with_range(df: DataFrame, keys: Sequence[Column], name: str = "__bin") -> DataFrame:
    """Add a range number that never decreases along ``keys``: NULL first, small tables get a single range.

    Every cut value is a range of its own, so a value that many rows share is isolated; when it alone would overload
    a task it is cut again along the second key.
    """
    lead = keys[0].cast("double")
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g")
    found = _quantiles(df, df.select(F.lit(0).alias("v"), group, lead.alias("x"))).get(0, [])
    repeats = Counter(found)
    cuts = sorted(repeats)
    if not cuts:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    bounds = _literal(cuts)
    at = array_position(bounds, lead, len(cuts), inclusive=False)
    upto = array_position(bounds, lead, len(cuts), inclusive=True)
    number = (at + upto).cast("bigint")
    shared = sorted(v for v in cuts if repeats[v] >= max(HOT_RANGES, len(found) // 256))
    if shared and len(keys) > 1 and isinstance(df.select(keys[1].alias("k")).schema["k"].dataType, T.NumericType):
        second = keys[1].cast("double")
        hot = df.select(lead.alias("v"), group, second.alias("x")).where(F.col("v").isin(shared))
        inner = {v: sorted(set(q)) for v, q in _quantiles(df, hot).items()}
        if inner:
            values = sorted(inner)
            slot = array_position(_literal(values), lead, len(values), inclusive=True) - F.lit(1)
            own = F.when(lead.isin(values), F.get(_literal([inner[v] for v in values]), slot))
            sub = array_position(own, second, max(len(q) for q in inner.values()), inclusive=False)
            number = number * F.lit(2 * MAX_BINS) + F.coalesce(sub, F.lit(0))
    return df.withColumn(name, number)


def _ascending(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _offsets(binned: DataFrame, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """Per (group, range): what all earlier ranges of the group add up to, and the group total."""
    per_bin = binned.groupBy(*by, "__bin").agg(*[F.sum(v).alias(f"__s_{k}") for k, v in totals.items()])
    before = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return per_bin.select(
        *by,
        "__bin",
        *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in totals],
        *[F.sum(f"__s_{k}").over(whole).alias(f"total_{k}") for k in totals],
    )


def running_totals(
    df: DataFrame, by: list[str], order: Sequence[Column | str], totals: dict[str, Column | str]
) -> DataFrame:
    """Add ``cum_<name>`` (inclusive running sum) and ``total_<name>`` (group sum) for every entry of ``totals``.

    ``order`` is ascending; its first entry must be numeric. Rows must be unique on ``by + order``.
    """
    keys = _ascending(order)
    values = {k: (F.col(v) if isinstance(v, str) else v) for k, v in totals.items()}
    binned = with_range(df, keys)
    offsets = _offsets(binned, by, values)
    joined = null_safe_join(binned, offsets, [*by, "__bin"])
    inside = Window.partitionBy(*by, "__bin").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, value in values.items():
        joined = joined.withColumn(f"cum_{name}", F.sum(value).over(inside) + F.col(f"__o_{name}"))
    return joined.drop("__bin", *[f"__o_{k}" for k in values])


def rank_rows(df: DataFrame, by: list[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """``row_number()`` over (partition by ``by`` order by ``order``), spread over the ranges of the leading key."""
    keys = _ascending(order)
    binned = with_range(df, keys)
    offsets = _offsets(binned, by, {"n": F.lit(1)})
    joined = null_safe_join(binned, offsets, [*by, "__bin"])
    inside = Window.partitionBy(*by, "__bin").orderBy(*keys)
    return joined.withColumn(name, F.row_number().over(inside) + F.col("__o_n")).drop("__bin", "__o_n", "total_n")


def first_k(df: DataFrame, by: list[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group for a constant ``k``.

    Spark turns the literal bound into a window group limit, so each input task forwards at most ``k`` rows a group.
    """
    w = Window.partitionBy(*by).orderBy(*_ascending(order))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= F.lit(int(k))).drop("__rn")


def best_row(df: DataFrame, by: list[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group."""
    return first_k(df, by, order, 1)


def order_cutoffs(df: DataFrame, by: list[str], order: Sequence[Column | str], targets: DataFrame) -> DataFrame:
    """For each group of ``targets (by..., target)`` the sort key of its ``target``-th row.

    Returns ``(by..., take_all, cutoff)``: ``take_all`` when the group has no more than ``target`` rows, and a NULL
    cut-off with ``take_all = false`` when the target is zero. Only the one range that holds the cut-off is ranked;
    the rows themselves are never shuffled.
    """
    keys = _ascending(order)
    narrow = df.select(*by, *[k.alias(f"__o{i}") for i, k in enumerate(keys)])
    names = [f"__o{i}" for i in range(len(keys))]
    binned = with_range(narrow, [F.col(n) for n in names])
    counts = binned.groupBy(*by, "__bin").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = null_safe_join(
        counts.withColumn("__cum", F.sum("__n").over(upto)).withColumn(
            "__all", F.sum("__n").over(Window.partitionBy(*by))
        ),
        targets,
        by,
    )
    edges = pinned(
        edges.withColumn("take_all", F.col("__all") <= F.col("target"))
        .where(
            (F.col("__cum") - F.col("__n") < F.greatest(F.col("target"), F.lit(1)))
            & (F.least(F.greatest(F.col("target"), F.lit(1)), F.col("__all")) <= F.col("__cum"))
        )
        .select(*by, "__bin", "take_all", (F.col("target") - (F.col("__cum") - F.col("__n"))).alias("__need"))
    )
    inside = Window.partitionBy(*by).orderBy(*names)
    edge_rows = null_safe_join(binned, edges.where(~F.col("take_all")), [*by, "__bin"])
    found = (
        edge_rows.withColumn("__rn", F.row_number().over(inside))
        .where(F.col("__rn") == F.col("__need"))
        .select(*by, F.struct(*names).alias("cutoff"))
    )
    return pinned(null_safe_join(edges.select(*by, "take_all"), found, by, "left"))


def take_smallest(df: DataFrame, by: list[str], order: Sequence[Column | str], targets: DataFrame) -> DataFrame:
    """Keep the first ``target`` rows of every group, where ``targets`` is a table ``(by..., target)``.

    Groups missing from ``targets`` are dropped. The data is filtered against per-group cut-offs in place.
    """
    keys = _ascending(order)
    cut = order_cutoffs(df, by, order, targets)
    own = F.struct(*[k.alias(f"__o{i}") for i, k in enumerate(keys)])
    joined = null_safe_join(df.withColumn("__own", own), cut, by)
    keep = F.col("take_all") | (F.col("__own") <= F.col("cutoff"))
    return joined.where(F.coalesce(keep, F.lit(False))).drop("__own", "take_all", "cutoff")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``; NULL values ignored.

    Equal values collapse into counts first (map-side), then positions are found through running totals, so no task
    holds the distinct values of a whole group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    cum = running_totals(counts, by, [value], {"c": "__c"})
    picks = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("total_c") - F.lit(1)).cast("double")
        picks.append(F.min(F.when(F.col("cum_c") > F.floor(pos), F.col(value))).alias(f"__lo_{name}"))
        picks.append(F.min(F.when(F.col("cum_c") > F.ceil(pos), F.col(value))).alias(f"__hi_{name}"))
    agg = cum.groupBy(*by).agg(F.max("total_c").alias("__n"), *picks)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__n") - F.lit(1)).cast("double")
        lo, hi = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return agg.select(*by, *out)
