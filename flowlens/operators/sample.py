"""Seeded stratified sampling. Every sample is "the k rows with the smallest key hash", so it does not depend on
partitioning or row order, and the same seed always gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.hashing import HASH_SPAN, row_hash
from flowlens.plans.ordered import first_k, take_smallest
from flowlens.plans.small import null_safe_join, pinned


def _order(key: list[str], seed: int) -> list[Column]:
    return [row_hash(*key, seed=seed), *[F.col(k) for k in key]]


def bottom_k_per_stratum(
    df: DataFrame, *, strata: list[str], k: int, key: list[str], seed: int = 0, by_value: str | None = None
) -> DataFrame:
    """The ``k`` rows of each stratum with the smallest hash, or the smallest value of a column (hash breaks ties)."""
    order = _order(key, seed)
    return first_k(df, strata, order if by_value is None else [F.col(by_value), *order], k)


def reservoir_per_class(df: DataFrame, *, label: str, k: int, key: list[str], seed: int) -> DataFrame:
    """A uniform sample of at most ``k`` rows per class."""
    return bottom_k_per_stratum(df, strata=[label], k=k, key=key, seed=seed)


def bernoulli_sample(df: DataFrame, *, key: list[str], rate: float, seed: int) -> DataFrame:
    """Keep each row with the given probability."""
    return df.where(row_hash(*key, seed=seed) < F.lit(int(rate * HASH_SPAN)))


def class_counts(df: DataFrame, *, by: list[str], label: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.when(F.col(label) == 1, F.lit(1))).alias("n_pos"),
        F.count(F.when(F.col(label) == 0, F.lit(1))).alias("n_neg"),
    )


def _long_targets(wide: DataFrame, by: list[str], label: str) -> DataFrame:
    pair = F.explode(
        F.array(
            F.struct(F.lit(1).alias(label), F.col("take_pos").alias("target")),
            F.struct(F.lit(0).alias(label), F.col("take_neg").alias("target")),
        )
    ).alias("t")
    return wide.select(*by, pair).select(*by, "t.*")


def proportional_targets(counts: DataFrame, max_rows: int) -> DataFrame:
    """``take_pos`` / ``take_neg`` that keep the class ratio within ``max_rows``; a short class is topped up."""
    n = F.col("n_pos") + F.col("n_neg")
    want = F.rint(F.lit(float(max_rows)) * F.col("n_pos") / F.greatest(n, F.lit(1))).cast("bigint")
    pos = F.least(want, F.col("n_pos"))
    neg = F.lit(max_rows) - pos
    short = neg > F.col("n_neg")
    whole = (n <= max_rows) | F.lit(max_rows <= 0)
    topped = F.least(F.col("n_pos"), F.lit(max_rows) - F.col("n_neg"))
    return counts.withColumns(
        {
            "take_pos": F.when(whole, F.col("n_pos")).when(short, topped).otherwise(pos),
            "take_neg": F.when(whole | short, F.col("n_neg")).otherwise(neg),
        }
    )


def keep_minority_targets(counts: DataFrame, max_rows: int) -> DataFrame:
    """All benign rows up to the limit, attacks fill what is left."""
    whole = (F.col("n_pos") + F.col("n_neg") <= max_rows) | F.lit(max_rows <= 0)
    neg = F.least(F.col("n_neg"), F.lit(max_rows))
    return counts.withColumns(
        {
            "take_pos": F.when(whole, F.col("n_pos")).otherwise(F.least(F.col("n_pos"), F.lit(max_rows) - neg)),
            "take_neg": F.when(whole, F.col("n_neg")).otherwise(neg),
        }
    )


def stratified_subsample(
    df: DataFrame, *, by: list[str], label: str, key: list[str], seed: int, max_rows: int, policy: str = "proportional"
) -> DataFrame:
    """At most ``max_rows`` per group: ``proportional`` keeps the class ratio, ``minority`` keeps every benign row."""
    pick = {"proportional": proportional_targets, "minority": keep_minority_targets}[policy]
    targets = pinned(_long_targets(pick(class_counts(df, by=by, label=label), max_rows), by, label))
    return take_smallest(df, [*by, label], _order(key, seed), targets)


def sample_balanced(
    df: DataFrame, *, by: str, label: str, n_attack: int, n_benign: int, key: list[str], seed: int
) -> DataFrame:
    """Up to ``n_attack`` and ``n_benign`` rows per group."""
    attack = first_k(df.where(F.col(label) == 1), [by], _order(key, seed), n_attack)
    benign = first_k(df.where(F.col(label) == 0), [by], _order(key, seed), n_benign)
    return attack.unionByName(benign)


def adaptive_target(pool: Column, fraction: Column, min_rows: Column, max_rows: Column) -> Column:
    """A fraction of the pool, clamped to optional bounds (NULL or 0 = none), at least 1 and at most the pool.

    Halves round to even.
    """
    raw = F.rint(pool.cast("double") * F.greatest(fraction, F.lit(0.0))).cast("bigint")
    low = F.when(min_rows > 0, F.greatest(raw, min_rows.cast("bigint"))).otherwise(raw)
    high = F.when(max_rows > 0, F.least(low, max_rows.cast("bigint"))).otherwise(low)
    return F.when(pool <= 0, F.lit(0)).otherwise(F.least(pool, F.greatest(F.lit(1), high))).cast("bigint")


def sample_by_bucket(
    df: DataFrame,
    *,
    by: str,
    label: str,
    is_val: str,
    key: list[str],
    seed: int,
    buckets: dict[tuple[bool, int], dict[str, float]],
) -> DataFrame:
    """Train/validation x benign/attack buckets, each with a fixed ``count`` or an adaptive ``fraction``."""
    pools = df.groupBy(by, is_val, label).agg(F.count("*").alias("pool"))
    target = F.lit(0).cast("bigint")
    for (val, y), cfg in buckets.items():
        hit = (F.col(is_val) == F.lit(val)) & (F.col(label) == y)
        if "count" in cfg:
            want = F.least(F.col("pool"), F.lit(int(cfg["count"])))
        else:
            want = adaptive_target(
                F.col("pool"),
                F.lit(float(cfg.get("fraction", 1.0))),
                F.lit(int(cfg.get("min_rows", 0))),
                F.lit(int(cfg.get("max_rows", 0))),
            )
        target = F.when(hit, want).otherwise(target)
    targets = pinned(pools.select(by, is_val, label, target.alias("target")))
    return take_smallest(df, [by, is_val, label], _order(key, seed), targets)


def protocol_targets(total: int, protocols: list[str]) -> dict[str, int]:
    """Split a total evenly; the first protocols take the remainder."""
    base, extra = divmod(int(total), max(1, len(protocols)))
    return {p: base + (1 if i < extra else 0) for i, p in enumerate(protocols)}


def quota_plan(
    counts: DataFrame, *, by: str, targets: dict[str, int], attack_ratio: float
) -> DataFrame:
    """Desired, available, actual and backfilled rows per protocol.

    Each class pool holds at most the protocol target; a shortage in one class is filled from the other.
    """
    rows = [
        (p, t, max(0, min(t, round(t * attack_ratio))), t - max(0, min(t, round(t * attack_ratio))))
        for p, t in targets.items()
    ]
    want = counts.sparkSession.createDataFrame(
        rows, f"{by} string, target_total bigint, target_attack bigint, target_benign bigint"
    )
    j = null_safe_join(want, counts, [by], "left").fillna(0, ["n_pos", "n_neg"])
    j = j.withColumns(
        {
            "pool_pos": F.least("n_pos", "target_total"),
            "pool_neg": F.least("n_neg", "target_total"),
        }
    ).withColumns(
        {
            "base_pos": F.least("pool_pos", "target_attack"),
            "base_neg": F.least("pool_neg", "target_benign"),
        }
    )
    j = j.withColumns(
        {
            "from_benign": F.least(
                F.col("target_attack") - F.col("base_pos"), F.col("pool_neg") - F.col("base_neg")
            ),
            "from_attack": F.least(
                F.col("target_benign") - F.col("base_neg"), F.col("pool_pos") - F.col("base_pos")
            ),
        }
    )
    return j.select(
        by,
        "target_total",
        "target_attack",
        "target_benign",
        F.col("n_pos").alias("available_attack"),
        F.col("n_neg").alias("available_benign"),
        (F.col("base_pos") + F.col("from_attack")).alias("take_pos"),
        (F.col("base_neg") + F.col("from_benign")).alias("take_neg"),
        "from_benign",
        "from_attack",
    )


def quota_sample(
    df: DataFrame, *, by: str, label: str, key: list[str], seed: int, total: int, attack_ratio: float,
    protocols: list[str],
) -> DataFrame:
    plan = quota_plan(
        class_counts(df, by=[by], label=label),
        by=by,
        targets=protocol_targets(total, protocols),
        attack_ratio=attack_ratio,
    )
    return take_smallest(df, [by, label], _order(key, seed), pinned(_long_targets(plan, [by], label)))


def sweep_pool_sizes(target: int, dynamic_fraction: float = 0.72) -> tuple[int, int]:
    """How many near-threshold and how many random rows a stratum pool keeps for a target."""
    keep = max(target + 700, -(-target * 22 // 10))
    dynamic = max(target, round(keep * dynamic_fraction))
    return dynamic, max(0, keep - dynamic)


def score_sweep_pools(
    df: DataFrame, *, by: str, label: str, abs_margin: str, key: list[str], seed: int, targets: dict[tuple[str, int], int],
    dynamic_fraction: float = 0.72,
) -> DataFrame:
    """Per stratum the rows nearest to the threshold plus a random rest, without repeats.

    ``targets`` maps (protocol, label) to the wanted rows; ``pool`` says which half a row came from.
    """
    spark = df.sparkSession
    sizes = {s: sweep_pool_sizes(t, dynamic_fraction) for s, t in targets.items()}
    schema = f"{by} string, {label} int, target bigint"
    near = spark.createDataFrame([(p, y, d) for (p, y), (d, _) in sizes.items()], schema)
    rest = spark.createDataFrame([(p, y, r) for (p, y), (_, r) in sizes.items()], schema)
    base = df.withColumn(label, F.col(label).cast("int"))
    nearest = [F.coalesce(F.col(abs_margin), F.lit(999.0)), *_order(key, seed)]
    a = take_smallest(base, [by, label], nearest, near).withColumn("pool", F.lit("dynamic"))
    b = take_smallest(base, [by, label], _order(key, seed), rest).withColumn("pool", F.lit("random"))
    only_random = b.join(a.select(*key), key, "left_anti")
    return a.unionByName(only_random)


def cap_fraction(
    df: DataFrame, *, by: str, group: str, pool_rows: int, fraction: float, key: list[str], seed: int
) -> DataFrame:
    """Cap the rows of one group at floor(fraction * pool); every other group passes through."""
    if fraction >= 1.0:
        return df
    limit = int(max(0.0, fraction) * max(0, pool_rows))
    rest = df.where(~F.col(by).eqNullSafe(F.lit(group)))
    mine = df.where(F.col(by) == group)
    targets = df.sparkSession.createDataFrame([(group, limit)], f"{by} string, target bigint")
    return rest.unionByName(take_smallest(mine, [by], _order(key, seed), targets))


def external_benign(
    base: DataFrame, external: DataFrame, *, key: list[str], by: str, label: str, protocols: list[str],
    cap: int | None = None, seed: int = 0,
) -> DataFrame:
    """External benign rows of known protocols that are not already in the base table.

    ``cap`` limits them before the overlap check, as a size parameter of the admission.
    """
    ok = external.where((F.col(label) == 0) & F.col(by).isin(protocols))
    if cap is not None:
        targets = ok.sparkSession.createDataFrame([(1, cap)], "__g int, target bigint")
        ok = take_smallest(ok.withColumn("__g", F.lit(1)), ["__g"], _order(key, seed), targets).drop("__g")
    return ok.join(base.select(*key), key, "left_anti")


def admission_summary(
    base: DataFrame, external: DataFrame, *, key: list[str], by: str, label: str, protocols: list[str]
) -> DataFrame:
    """Rows offered, dropped by the basic filter, dropped as overlap, and kept."""
    seen = base.select(*key).distinct().withColumn("__seen", F.lit(True))
    ok = (F.col(label) == 0) & F.col(by).isin(protocols)
    j = external.join(seen, key, "left")
    hit = F.col("__seen").isNotNull()
    return j.agg(
        F.count("*").alias("rows_raw"),
        F.count(F.when(~ok, F.lit(1))).alias("dropped_basic"),
        F.count(F.when(ok & hit, F.lit(1))).alias("dropped_overlap"),
        F.count(F.when(ok & ~hit, F.lit(1))).alias("rows_kept"),
    )
