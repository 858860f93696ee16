"""Logistic models of all groups at once: each Newton step is one grouped aggregate and a small solve for each group."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowlens.functions.numeric import sigmoid
from flowlens.operators.score import LinearModel
from flowlens.plans.small import MAX_PINNED_ROWS, local, null_safe_join

FLOOR = 1e-6  # a deviation below counts as 1


@dataclass
class _Group:
    """What a group's fit has come to: coefficients with the bias first, the last move and the loss before it."""

    beta: np.ndarray
    move: np.ndarray
    loss: float = math.inf
    done: bool = False

    def step(self, row: dict, width: int, reg: float, tolerance: float) -> None:
        total = row["w"]
        loss = row["loss"] / total + 0.5 * reg * float((self.beta[1:] ** 2).sum())
        if not loss <= self.loss + 1e-12:  # too far: half of the last move back
            self.move = self.move / 2
            self.beta = self.beta - self.move
            return
        self.loss = loss
        ridge = np.diag([0.0, *[reg] * (width - 1)])
        hessian, slope = np.empty((width, width)), np.empty(width)
        for i in range(width):
            slope[i] = row[f"r{i}"] / total
            for j in range(i, width):
                hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"] / total
        slope -= ridge @ self.beta
        self.move = np.linalg.lstsq(hessian + ridge, slope, rcond=None)[0]
        self.beta = self.beta + self.move
        self.done = bool(np.abs(self.move).max() <= tolerance)


def _collected(df: DataFrame) -> list[dict]:
    rows = df.limit(MAX_PINNED_ROWS + 1).collect()
    if len(rows) > MAX_PINNED_ROWS:
        raise ValueError(f"more than {MAX_PINNED_ROWS} groups to fit")
    return [r.asDict() for r in rows]


def fit_logistic(
    df: DataFrame, *, features: list[str], label: str, by: str, weight: str | None = None, reg: float = 1e-4,
    max_iter: int = 50, tolerance: float = 1e-9,
) -> dict[str | None, LinearModel]:
    """One weighted logistic model per group over standardised features, by iteratively reweighted least squares.

    The mean loss plus ``reg / 2`` times the squared weights (not the bias) is brought to its minimum. Every step reads the
    rows once for all groups that still move: sums of the curvature and the slope of each group come back, one row a group. A
    step that raises the loss is halved. A group with one class gets zero weights. Rows without a label, a weight or one of
    the features take no part; NULL is a group of its own.
    """
    x = [F.col(f"`{f}`").cast("double") for f in features]
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    y = F.col(label).cast("double")
    rows = df.select(F.col(by).alias("g"), y.alias("y"), w.alias("w"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    whole = F.col("y").isNotNull() & F.col("w").isNotNull()
    for i in range(len(features)):
        whole = whole & F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}")
    rows = rows.where(whole)
    moments = [f(f"x{i}").alias(f"{s}{i}") for i in range(len(features)) for s, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = {r["g"]: r for r in _collected(rows.groupBy("g").agg(*moments, F.min("y").alias("low"), F.max("y").alias("high")))}
    width = len(features) + 1
    found: dict[str | None, _Group] = {}
    for g, r in stats.items():
        r["mean"] = [r[f"m{i}"] for i in range(len(features))]
        r["std"] = [r[f"s{i}"] if r[f"s{i}"] > FLOOR else 1.0 for i in range(len(features))]
        found[g] = _Group(np.zeros(width), np.zeros(width), done=r["low"] == r["high"])
    spark, numbers = df.sparkSession, T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("g", rows.schema["g"].dataType), *[T.StructField(c, numbers) for c in ("mean", "std", "b")]])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    for _ in range(max_iter):
        left = [(g, stats[g]["mean"], stats[g]["std"], f.beta.tolist()) for g, f in found.items() if not f.done]
        if not left:
            break
        # of a known size, so that it is broadcast and no step moves the rows
        now = local(spark, pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*left, strict=True), kinds, strict=True)], schema.names), schema)
        for r in _collected(_sums(null_safe_join(rows, now, ["g"]), width)):
            found[r["g"]].step(r, width, reg, tolerance)
    return {
        g: LinearModel(
            {f: float(v) for f, v in zip(features, found[g].beta[1:], strict=True)}, float(found[g].beta[0]),
            dict(zip(features, r["mean"], strict=True)), dict(zip(features, r["std"], strict=True)),
        )
        for g, r in sorted(stats.items(), key=lambda kv: (kv[0] is None, kv[0] or ""))
    }


def _sums(joined: DataFrame, width: int) -> DataFrame:
    """For each group the sums of weights, losses, slopes and curvature at its coefficients."""
    x: list[Column] = [F.lit(1.0)]
    x += [(F.col(f"x{i}") - F.get("mean", F.lit(i))) / F.get("std", F.lit(i)) for i in range(width - 1)]
    scaled = joined.select("g", "y", "w", "b", *[c.alias(f"z{i}") for i, c in enumerate(x)])
    total = F.lit(0.0)
    for i in range(width):
        total = total + F.get("b", F.lit(i)) * F.col(f"z{i}")
    at = scaled.withColumn("t", total).withColumn("p", sigmoid("t"))
    signed = F.col("t") * (F.lit(2.0) * F.col("y") - F.lit(1.0))
    loss = F.col("w") * (F.log1p(F.exp(-F.abs(signed))) + F.greatest(-signed, F.lit(0.0)))
    bend = F.col("w") * F.col("p") * (F.lit(1.0) - F.col("p"))
    aggs = [F.sum("w").alias("w"), F.sum(loss).alias("loss")]
    aggs += [F.sum(F.col("w") * (F.col("y") - F.col("p")) * F.col(f"z{i}")).alias(f"r{i}") for i in range(width)]
    aggs += [F.sum(bend * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i in range(width) for j in range(i, width)]
    return at.groupBy("g").agg(*aggs)
