"""Routed scoring: every row is scored by its protocol's model and compared to that protocol's threshold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.coerce import direction, protocol_slug, slug_text
from flowlens.functions.numeric import linear_term, passes, sigmoid
from flowlens.plans.ordered import first_k
from flowlens.plans.small import null_safe_join

Scorer = Callable[[dict[str, Column]], Column]


@dataclass(frozen=True)
class LinearModel:
    """A logistic model over standardised features."""

    weights: dict[str, float]
    bias: float = 0.0
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)

    def contribution(self, name: str, x: Column) -> Column:
        """Signed share of one feature in the log-odds."""
        centred = (x - F.lit(float(self.mean.get(name, 0.0)))) / F.lit(float(self.std.get(name, 1.0)))
        return F.lit(float(self.weights[name])) * centred

    def logit(self, cols: dict[str, Column]) -> Column:
        z = F.lit(float(self.bias))
        for name in self.weights:
            z = z + self.contribution(name, cols[name])
        return z

    def score(self, cols: dict[str, Column]) -> Column:
        return sigmoid(self.logit(cols))


def slugged(values: dict[str, object]) -> dict:
    """The same values under the slugs of their keys, which is how rows name their protocol."""
    out = {slug_text(k): v for k, v in values.items()}
    if len(out) != len(values):
        raise ValueError(f"protocols that differ only in spelling: {sorted(map(str, values))}")
    return out


def default_protocol(protocols: list[str]) -> str:
    return "wifi" if "wifi" in protocols else sorted(protocols)[0]


def route(protocol: Column | str, known: list[str], default: str | None = None) -> Column:
    """The protocol whose model scores the row: its own when there is one, else the default."""
    slug, known = protocol_slug(protocol), [slug_text(k) for k in known]
    return F.when(slug.isin(known), slug).otherwise(F.lit(slug_text(default) if default else default_protocol(known)))


def by_protocol(protocol: Column, values: dict[str, Column], default: Column | None = None) -> Column:
    """Pick one of a few per-protocol expressions."""
    out: Column | None = None
    for name, value in values.items():
        out = F.when(protocol == name, value) if out is None else out.when(protocol == name, value)
    if out is None:
        raise ValueError("by_protocol needs at least one value")
    return out if default is None else out.otherwise(default)


def threshold_lookup(df: DataFrame, thresholds: DataFrame, *, on: str, default: float = 0.5) -> DataFrame:
    """Many-to-one join to a ``(protocol, threshold)`` table; rows without a match get the default."""
    return null_safe_join(df, thresholds.select(on, "threshold"), [on], "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(default))
    )


def resolve_thresholds(
    protocols: DataFrame, custom: DataFrame, table: DataFrame, metrics: DataFrame, *, on: str, default: float = 0.5
) -> DataFrame:
    """First source that has a finite threshold wins: custom, then table, then metrics, then the default."""
    out = protocols.select(on).distinct()
    for i, source in enumerate((custom, table, metrics)):
        value = F.when(~F.isnan("threshold") & (F.abs("threshold") < float("inf")), F.col("threshold"))
        src = source.select(on, value.alias(f"t{i}"))
        out = null_safe_join(out, src, [on], "left")
    origin = (
        F.when(F.col("t0").isNotNull(), F.lit("custom"))
        .when(F.col("t1").isNotNull(), F.lit("table"))
        .when(F.col("t2").isNotNull(), F.lit("metrics"))
        .otherwise(F.lit("default"))
    )
    return out.select(on, F.coalesce("t0", "t1", "t2", F.lit(default)).alias("threshold"), origin.alias("origin"))


def routed_score(
    df: DataFrame,
    models: dict[str, LinearModel],
    thresholds: dict[str, float],
    *,
    protocol: str = "protocol_hint",
    default: str | None = None,
) -> DataFrame:
    """Add ``protocol_used, score_attack, threshold, prediction, margin, abs_margin``; a projection, no shuffle.

    Models and thresholds are looked up by the slug of their protocol; one without a threshold gets 0.5.
    """
    models, thresholds = slugged(models), slugged(thresholds)
    cols = {f: F.col(f"`{f}`") for m in models.values() for f in m.weights}
    out = df.withColumn("protocol_used", route(protocol, list(models), default))
    used = F.col("protocol_used")
    out = out.withColumns(
        {
            "score_attack": by_protocol(used, {p: m.score(cols) for p, m in models.items()}),
            "threshold": by_protocol(used, {p: F.lit(float(t)) for p, t in thresholds.items()}, F.lit(0.5))
            if thresholds
            else F.lit(0.5),
        }
    )
    return with_margin(out)


def with_margin(df: DataFrame, score: str = "score_attack") -> DataFrame:
    out = df.withColumn("prediction", passes(score, "threshold").cast("int"))
    out = out.withColumn("margin", F.col(score) - F.col("threshold"))
    return out.withColumn("abs_margin", F.abs("margin"))


def routed_score_strict(
    df: DataFrame, models: dict[str, LinearModel], thresholds: dict[str, float], *, protocol: str = "protocol_hint"
) -> DataFrame:
    """As ``routed_score``, but rows of an unknown protocol are dropped."""
    known = list(slugged(models))
    return routed_score(df.where(protocol_slug(protocol).isin(known)), models, thresholds, protocol=protocol)


def contributions(df: DataFrame, models: dict[str, LinearModel], *, name: str = "contributions") -> DataFrame:
    """Array of ``struct(feature, contribution, abs_contribution, direction)`` per row, largest effect first."""
    models = slugged(models)
    features = sorted({f for m in models.values() for f in m.weights})
    cells = []
    for f in features:
        value = by_protocol(
            F.col("protocol_used"),
            {p: m.contribution(f, F.col(f"`{f}`")) if f in m.weights else F.lit(0.0) for p, m in models.items()},
        )
        cells.append(
            F.struct(
                (-F.abs(value)).alias("k"),
                F.lit(f).alias("feature"),
                value.alias("contribution"),
                F.abs(value).alias("abs_contribution"),
                direction(value).alias("direction"),
            )
        )
    ordered = F.array_sort(F.array(*cells))
    return df.withColumn(
        name,
        F.transform(ordered, lambda c: F.struct(c["feature"], c["contribution"], c["abs_contribution"], c["direction"])),
    )


def top_contributions(arr: Column | str, n: int) -> Column:
    return F.slice(F.col(arr) if isinstance(arr, str) else arr, 1, n)


def mean_abs_contribution(df: DataFrame, models: dict[str, LinearModel]) -> DataFrame:
    """Mean absolute contribution per protocol and feature, ranked; a wide aggregate, rows are not multiplied."""
    models = slugged(models)
    features = sorted({f for m in models.values() for f in m.weights})
    used = F.col("protocol_used")
    aggs = []
    for i, f in enumerate(features):
        value = by_protocol(
            used, {p: m.contribution(f, F.col(f"`{f}`")) if f in m.weights else F.lit(0.0) for p, m in models.items()}
        )
        aggs += [F.avg(F.abs(value)).alias(f"a{i}"), F.avg(value).alias(f"c{i}")]
    wide = df.groupBy("protocol_used").agg(*aggs)
    cells = [
        F.struct(F.lit(f).alias("feature"), F.col(f"a{i}").alias("mean_abs"), F.col(f"c{i}").alias("mean_signed"))
        for i, f in enumerate(features)
    ]
    return wide.select("protocol_used", F.explode(F.array(*cells)).alias("c")).select("protocol_used", "c.*")


def overall_importance(per_protocol: DataFrame, *, per_top: int = 20, top: int = 25) -> DataFrame:
    """Sum over protocols of each protocol's strongest features, strongest first."""
    best = first_k(per_protocol, ["protocol_used"], [F.col("mean_abs").desc(), F.col("feature")], per_top)
    total = best.groupBy("feature").agg(F.sum("mean_abs").alias("importance"))
    return total.orderBy(F.col("importance").desc(), "feature").limit(top)


def positive_unlocked_features(per_protocol: DataFrame, locked: list[str], k: int) -> DataFrame:
    """The ``k`` unlocked features per protocol that push most towards attack."""
    ok = per_protocol.where((F.col("mean_signed") > 0) & ~F.col("feature").isin(locked))
    return first_k(ok, ["protocol_used"], [F.col("mean_signed").desc(), F.col("feature")], k)


def linear_score_column(weights: dict[str, float], bias: float) -> Column:
    return sigmoid(linear_term(weights, bias))
