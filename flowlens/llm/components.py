"""Connected components of an edge table, by repeated contraction with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.plans.small import cut_lineage


def apart(column: str) -> Column:
    """The same number as an expression of its own.

    A join key that an aggregate has just been dealt by needs no new exchange, and then Spark can't split a hot key of
    the other side. As an expression it gets one.
    """
    return F.col(column).bitwiseXOR(F.lit(0).cast("long"))


def relabel(rows: DataFrame, column: str, low: DataFrame) -> DataFrame:
    """``column`` replaced by its label in ``low(node, label)``, where it has one."""
    other = low.select(apart("node").alias("__node"), F.col("label").alias("__label"))
    new = F.coalesce("__label", column).alias(column)
    return rows.join(other, F.col(column) == F.col("__node"), "left").select(
        *[new if c == column else F.col(c) for c in rows.columns]
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)`` (longs); a component has one of its nodes as its name.

    Each round maps every node to the lowest of itself and its neighbours and keeps the distinct edges between what is
    left. Minima are combined before the shuffle, so that a hub costs no more than its edges, and no group of neighbours is
    ever gathered. Null ends are left out, as are loops.
    """
    edges = cut_lineage(edges.where("a <> b").select("a", "b").distinct())
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        low = cut_lineage(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
        labels = low if labels is None else cut_lineage(relabel(labels, "label", low))
        edges = cut_lineage(relabel(relabel(edges, "a", low), "b", low).where("a <> b").distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.select("node", F.col("label").alias("component"))
