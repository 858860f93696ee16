"""Mixing sources to target weights: exact block quotas split among output shards by a hypergeometric tree.

DataFrame operations only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.common import SPACES, whole_text
from flowlens.plans.small import cut_lineage, null_safe_join, small_enough

CELLS = 1024  # ranges of the hash; a source's documents in one of them are a block
SHARDS = 16
MOST = 3  # times a document may be taken
SEED = "mix"
KEY_BITS = 60
MAX_BLOCK_ROWS = 100_000
WORDS_PER_TASK = 1 << 22


def words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(f"[^{SPACES}]+")).cast("long")


def order_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The place of a row in its source's permuted order: the first 60 bits of an md5 of seed, id and text."""
    name = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(whole_text(text)))
    return F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long")


def cell_of(key: str | Column) -> Column:
    return F.shiftright(F.col(key) if isinstance(key, str) else key, KEY_BITS - CELLS.bit_length() + 1).cast("int")


def first_until(rows: DataFrame, group: str, goals: DataFrame) -> DataFrame:
    """Where to cut each group's rows, in the order of ``key``, so that the weights before the cut sum to its goal.

    ``rows(group, key, weight)``, ``goals(group, goal)``. Returns ``(group, cut_cell, cut_key)``: rows in an earlier cell, or
    in that cell with a key up to ``cut_key``, are taken. A row at the cut is in if half of it or more is. Sums by (group, cell)
    find the one cell with the cut; only its rows are ordered. Equal keys go together.
    """
    sums = rows.groupBy(group, cell_of("key").alias("cell")).agg(F.sum("weight").alias("weight"))
    until = Window.partitionBy(group).orderBy("cell")
    sums = null_safe_join(sums, goals, [group]).withColumn("upto", F.sum("weight").over(until))
    sums = sums.withColumn("before", F.col("upto") - F.col("weight"))
    inside = (F.col("before") <= F.col("goal")) & (F.col("upto") > F.col("goal"))
    cut = cut_lineage(sums.where(inside).select(group, F.col("cell").alias("cut_cell"), "before", "goal"))  # a row a group
    near = null_safe_join(rows.where(F.col("weight") > 0), small_enough(cut), [group]).where(cell_of("key") == F.col("cut_cell"))
    upto = F.col("before") + F.sum("weight").over(Window.partitionBy(group).orderBy("key"))
    fits = upto * 2 - F.col("weight") <= F.col("goal") * 2
    last = near.withColumn("fits", fits).where("fits").groupBy(group).agg(F.max("key").alias("cut_key"))
    # no cell with the cut: the goal is the whole group, or more
    whole = goals.select(group, F.lit(CELLS).alias("no_cut"))
    found = null_safe_join(whole, cut.select(group, "cut_cell"), [group], "left")
    found = null_safe_join(found, last, [group], "left")
    return found.select(
        group, F.coalesce("cut_cell", "no_cut").alias("cut_cell"), F.coalesce("cut_key", F.lit(-1).cast("long")).alias("cut_key")
    )


def before_cut(key: str) -> Column:
    cell = cell_of(key)
    return (cell < F.col("cut_cell")) | ((cell == F.col("cut_cell")) & (F.col(key) <= F.col("cut_key")))


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: weights 1, 2, 3 repeating over the sources by name, null last, share
    the total; no target exceeds three times its source, what is over goes to the others by weight.

    In the order of size to weight, sources reach that bound until the level of the rest is below it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    every = Window.partitionBy(F.lit(0))
    by_bound = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_bound.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    most = F.col("source_size") * MOST
    ranked = (
        weighed.withColumn("total", F.sum("source_size").over(every))
        .withColumn("most_before", F.sum(most).over(upto) - most)
        .withColumn("weight_left", F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))
    )
    bound = most.cast("double") * F.col("weight_left") <= (F.col("total") - F.col("most_before")).cast("double") * F.col("weight")
    ranked = ranked.withColumn("bound", bound)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("bound"), most)).over(every), F.lit(0))
    open_weight = F.sum(F.when(~F.col("bound"), F.col("weight"))).over(every)
    share = (rest * F.col("weight")).cast("double") / open_weight
    return ranked.withColumn("target", F.when(F.col("bound"), most.cast("double")).otherwise(share)).select(
        "source", "source_size", "target"
    )


def split_tree(items: DataFrame, shards: int) -> DataFrame:
    """``items(source, cell, turn)`` with ``shard``: the quotas of a node, one item for each block and turn, are halved again
    and again. The items with the lowest hashes of a node go left, as many as its share of shards: the counts by
    source that this gives are a multivariate hypergeometric draw from the node's quotas, and the two sides are disjoint.
    """
    items = cut_lineage(items.withColumn("low", F.lit(0)).withColumn("high", F.lit(shards)))
    level = 0
    while shards > 1:
        key = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(level), "low", "source", "cell", "turn"), 64 - KEY_BITS)
        keyed = items.withColumn("key", key).withColumn("weight", F.lit(1).cast("long"))
        nodes = keyed.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"))
        middle = F.expr("(low + high) div 2").cast("int")
        goals = nodes.select("low", F.expr("n * ((low + high) div 2 - low) div (high - low)").alias("goal"))
        cuts = small_enough(cut_lineage(first_until(keyed, "low", goals)))  # a row for each node
        halved = null_safe_join(keyed, cuts, ["low"]).withColumn("left", before_cut("key")).withColumn("middle", middle)
        single = F.col("high") - F.col("low") == 1
        items = cut_lineage(
            halved.select(
                "source",
                "cell",
                "turn",
                F.when(single | F.col("left"), F.col("low")).otherwise(F.col("middle")).alias("low"),
                F.when(single | ~F.col("left"), F.col("high")).otherwise(F.col("middle")).alias("high"),
            )
        )
        shards, level = (shards + 1) // 2, level + 1
    return items.select("source", "cell", "turn", F.col("low").alias("shard"))


@dataclass
class Plan:
    """``sources``: a row for each, with target, whole turns and cut. ``blocks``: for each source and cell the shards of its
    turns. ``rows``: (doc_id, source, size, key) of every document."""

    sources: DataFrame
    blocks: DataFrame
    rows: DataFrame


def plan(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> Plan:
    rows = cut_lineage(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), words(text).alias("size"), order_key(text).alias("key"))
    )
    cells = cut_lineage(
        rows.groupBy("source", cell_of("key").alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    )
    sized = targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")))
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sized = cut_lineage(sized.withColumn("turns", turns.cast("int")))
    goals = sized.select("source", (F.col("target") - F.col("turns") * F.col("source_size")).alias("goal")).where("goal > 0")
    cuts = first_until(rows.select("source", "key", F.col("size").alias("weight")), "source", goals)
    sources = cut_lineage(null_safe_join(sized, cuts, ["source"], "left"))
    partly = F.coalesce(F.col("cell") <= F.col("cut_cell"), F.lit(False)).cast("int")
    items = null_safe_join(cells, small_enough(sources), ["source"]).select(
        "source", "cell", F.explode(F.sequence(F.lit(1), F.lit(MOST + 1))).alias("turn"), (F.col("turns") + partly).alias("upto")
    )
    drawn = split_tree(items.where("turn <= upto").drop("upto"), shards)
    blocks = drawn.groupBy("source", "cell").agg(F.sort_array(F.collect_list(F.struct("turn", "shard"))).alias("drawn"))
    return Plan(sources, cut_lineage(blocks), rows)


def with_copies(rows: DataFrame, mix: Plan) -> DataFrame:
    """``rows(source, size, key, ...)`` with ``source_size``, ``target`` and ``copies``: (turn, shard) for each time taken."""
    known = null_safe_join(rows, small_enough(mix.sources), ["source"]).withColumn("cell", cell_of("key"))
    blocks = small_enough(mix.blocks, MAX_BLOCK_ROWS)
    known = null_safe_join(known, blocks, ["source", "cell"], "left")
    extra = F.coalesce(before_cut("key"), F.lit(False)).cast("int")
    copies = F.slice(F.coalesce("drawn", F.array().cast("array<struct<turn:int,shard:int>>")), 1, F.col("turns") + extra)
    return known.select(*rows.columns, "source_size", "target", copies.alias("copies"))


def mix_table(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)`` of every row of ``docs``.

    Size is the number of words (null text: 0); a null source is a source. A source is taken in whole turns and one more up
    to a cut in its permuted order, so that its words come within half a document of its target. Rows equal in id and text
    are taken equally often. An empty table gives an empty one; other columns are not read.
    """
    made = plan(docs, shards, text)
    return with_copies(made.rows, made).drop("key")


def mixture(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """The mixed rows: ``docs``, each as often as it is taken, a shard's rows together in a shuffled order.

    All columns pass through, none is added. See ``mix_table``.
    """
    made = plan(docs, shards, text)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("source").cast("string").alias("source"),
        words(text).alias("size"),
        order_key(text).alias("key"),
    )
    taken = with_copies(keyed, made).select("doc", "key", F.explode("copies").alias("copy"))
    total = made.sources.agg(F.sum("target")).first()[0] or 0.0
    tasks = max(1, math.ceil(total / shards / WORDS_PER_TASK))  # for each shard, ranges of its order
    order = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "copy.turn", "key"), 1)
    dealt = taken.select("doc", F.col("copy.shard").alias("shard"), order.alias("order"))
    task = F.col("shard") * tasks + F.shiftright(F.shiftright("order", 33) * tasks, 30)
    return dealt.repartitionById(shards * tasks, task.cast("int")).sortWithinPartitions("order").select("doc.*")
