"""Replay orders, ticks and running counts of a scored table.

Positions come from distributed ranking, so no order needs a one-task sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.numeric import passes
from flowlens.functions.hashing import row_hash
from flowlens.plans.ordered import first_k, rank_rows, running_totals
from flowlens.plans.small import cut_lineage, null_safe_join, pinned
from flowlens.plans.turns import group_sizes, place_in_turn, turn_tables

SATURATED = 0.9999


def first_n_per_group(df: DataFrame, *, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    return first_k(df, by, order, n)


def case_ids(df: DataFrame, *, protocol: str, outcome: str, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows per protocol and outcome with a readable running id."""
    cases = first_k(df, [protocol, outcome], order, n)
    rn = F.row_number().over(Window.partitionBy(protocol, outcome).orderBy(*order))
    return cases.withColumn("case_id", F.format_string("%s_%s_%03d", F.col(protocol), F.col(outcome), rn))


def interleave(df: DataFrame, *, by: list[str], order: list[Column | str], seed: int, name: str = "replay_pos") -> DataFrame:
    """Take the i-th row of every group in turn; groups rotate in a seeded order.

    Only rows inside their groups are ordered; the place of a turn follows from the sizes of the groups.
    """
    sizes = group_sizes(df, by)
    tables = turn_tables(sizes, [], by, [row_hash(*by, seed=seed), *[F.col(b) for b in by]], sizes.isLocal())
    ranked = rank_rows(df, by, order, "__turn")
    return place_in_turn(ranked, tables, by, "__turn", name).drop("__turn")


def interleave_nested(
    df: DataFrame, *, outer: str, inner: str, order: list[Column | str], seed: int, name: str = "replay_pos"
) -> DataFrame:
    """Interleave the inner groups inside every outer group, then the outer groups. One order, that of the innermost rows."""
    sizes = group_sizes(df, [outer, inner])
    few = sizes.isLocal()
    inside = turn_tables(sizes, [outer], [inner], [row_hash(inner, seed=seed), F.col(inner)], few)
    whole = sizes.groupBy(outer).agg(F.sum("size").alias("size"))
    across = turn_tables(whole, [], [outer], [row_hash(outer, seed=seed), F.col(outer)], few)
    ranked = rank_rows(df, [outer, inner], order, "__turn")
    within = place_in_turn(ranked, inside, [outer, inner], "__turn", "__step")
    return place_in_turn(within, across, [outer], "__step", name).drop("__turn", "__step")


def replay_order(
    df: DataFrame, *, mode: str, key: str, source: str, protocol: str, seed: int, name: str = "replay_pos"
) -> DataFrame:
    """``sequential``, ``shuffle``, ``interleave-source`` or ``interleave-protocol-source``; ``key`` is numeric."""
    if mode == "shuffle":
        return rank_rows(df, [], [row_hash(key, seed=seed), F.col(key)], name)
    if mode == "interleave-source":
        return interleave(df, by=[source], order=[F.col(key)], seed=seed, name=name)
    if mode == "interleave-protocol-source":
        return interleave_nested(df, outer=protocol, inner=source, order=[F.col(key)], seed=seed, name=name)
    return rank_rows(df, [], [F.col(key)], name)


def dynamic_alert(score: str = "score_attack", threshold: str = "threshold", pred: str = "prediction") -> Column:
    """An alert that is not saturated, so its margin still says something."""
    return (F.col(pred) == 1) & passes(score, threshold) & (F.col(score) < F.lit(SATURATED))


def front_load_alerts(
    df: DataFrame, *, protocol: str, protocols: list[str], source: str, key: str, n: int, seed: int,
    score: str = "score_attack", name: str = "replay_pos",
) -> DataFrame:
    """Move ``n`` near-threshold alerts to the front, interleaved; everything else keeps its order.

    ``n / len(protocols)`` per protocol first, the rest from whichever protocol is nearest. The prefix holds at most
    ``n`` rows, a parameter, so only its ids travel to the data.
    """
    near = [F.col("abs_margin"), F.col(score), F.col(key)]
    dynamic = df.where(dynamic_alert(score))
    share = max(1, n // max(1, len(protocols)))
    per_protocol = first_k(dynamic.where(F.col(protocol).isin(protocols)), [protocol], near, share).withColumn(
        "__first", F.lit(0)
    )
    pool = dynamic.orderBy(*near).limit(n + share * len(protocols)).withColumn("__first", F.lit(1))
    both = per_protocol.unionByName(pool.join(per_protocol.select(key), key, "left_anti").select(*per_protocol.columns))
    quota = F.greatest(F.lit(n), F.sum(F.lit(1) - F.col("__first")).over(Window.partitionBy()))
    order = Window.partitionBy().orderBy("__first", *near)
    chosen = (
        both.withColumns({"__quota": quota, "__rn": F.row_number().over(order)})
        .where(F.col("__rn") <= F.col("__quota"))
        .drop("__first", "__quota", "__rn")
    )
    prefix = interleave_nested(
        chosen, outer=protocol, inner=source, order=[F.col(key)], seed=seed, name="__prefix"
    ).select(key, "__prefix")
    prefix = pinned(prefix, max_rows=max(1, 2 * n))
    size = prefix.count()
    marked = df.join(prefix, key, "left")
    rest = rank_rows(marked.where(F.col("__prefix").isNull()), [], [F.col(key)], "__rest")
    head = marked.where(F.col("__prefix").isNotNull()).withColumn(name, F.col("__prefix").cast("bigint"))
    tail = rest.withColumn(name, (F.col("__rest") + F.lit(size)).cast("bigint")).drop("__rest")
    return head.unionByName(tail).drop("__prefix")


def tick_assign(pos: Column | str, rate: int) -> Column:
    """The second in which a replay position leaves, at 1 to 10 rows a second."""
    p = F.col(pos) if isinstance(pos, str) else pos
    return F.floor((p - F.lit(1)) / F.lit(max(1, min(10, int(rate))))) + F.lit(1)


def running_counts(df: DataFrame, *, by: list[str], tick: str, pred: str = "prediction") -> DataFrame:
    """Flows and alerts so far per tick. The ticks are stored, since their order is found before they are summed up."""
    per_tick = cut_lineage(
        df.groupBy(*by, tick).agg(
            F.count("*").alias("flows"), F.count(F.when(F.col(pred) == 1, F.lit(1))).alias("alerts")
        )
    )
    cum = running_totals(per_tick, by, [tick], {"flows": "flows", "alerts": "alerts"})
    return cum.select(*by, tick, "flows", "alerts", "cum_flows", "cum_alerts")


def recent_alerts(df: DataFrame, *, tick: str, pos: str, cap: int = 250, per_tick: int | None = None) -> DataFrame:
    """The newest alerts: latest tick first, replay order inside a tick; ``cap`` is the feed length."""
    alerts = df.where(F.col("prediction") == 1)
    if per_tick is not None:
        alerts = first_k(alerts, [tick], [F.col(pos)], per_tick)
    return alerts.orderBy(F.col(tick).desc(), F.col(pos)).limit(cap)


def session_counters(df: DataFrame, *, protocol: str, pred: str = "prediction") -> DataFrame:
    counts = df.groupBy(protocol).agg(
        F.count("*").alias("flows"), F.count(F.when(F.col(pred) == 1, F.lit(1))).alias("alerts")
    )
    ratio = F.when(F.col("flows") > 0, F.col("alerts") / F.col("flows")).otherwise(F.lit(0.0))
    return counts.withColumn("alert_ratio", ratio)


def first_alert(df: DataFrame, *, order: str, columns: list[str], pred: str = "prediction") -> DataFrame:
    """The earliest alert, through a single aggregate."""
    hit = F.when(F.col(pred) == 1, F.struct(F.col(order), *[F.col(c) for c in columns if c != order]))
    return df.agg(F.min(hit).alias("a")).where(F.col("a").isNotNull()).select("a.*")


def alert_quantiles(df: DataFrame, *, by: str, score: str = "score_attack") -> DataFrame:
    """10th, 50th and 90th percentile of alert scores; 0 where a group has no alert."""
    from flowlens.plans.ordered import exact_quantiles

    groups = df.groupBy(by).agg(F.count(F.when(F.col("prediction") == 1, F.lit(1))).alias("alerts"))
    q = exact_quantiles(df.where(F.col("prediction") == 1), [by], score, {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return null_safe_join(groups, q, [by], "left").fillna(0.0, ["q10", "q50", "q90"])


def sweep_counts(df: DataFrame, *, by: str, score: str = "score_attack") -> DataFrame:
    return df.groupBy(by).agg(
        F.count("*").alias("scored_rows"),
        F.count(F.when(F.col("prediction") == 1, F.lit(1))).alias("alerts"),
        F.count(F.when((F.col("prediction") == 1) & (F.col(score) < F.lit(SATURATED)), F.lit(1))).alias(
            "non_saturated_alerts"
        ),
    )


def search_alerts(df: DataFrame, *, protocol: str = "all", family: str = "") -> DataFrame:
    """Alert feed filter: a protocol (or ``all``) and a case-insensitive part of the family."""
    out = df.where(F.col("prediction") == 1)
    if protocol != "all":
        out = out.where(F.col("protocol_hint") == protocol)
    return out.where(F.lower("attack_family").contains(family.strip().lower()))
