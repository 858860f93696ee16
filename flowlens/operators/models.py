"""Per-protocol classifiers on Spark ML, boosted stumps as plain aggregates, tuning, blending and leaderboards."""

from __future__ import annotations

import json
import math
import random

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.numeric import sigmoid
from flowlens.operators.logistic import fit_logistic as train_logistic
from flowlens.operators.metrics import GLOBAL_SCOPE
from flowlens.operators.rank_metrics import roc_points
from flowlens.operators.thresholds import validation_objective


def _groups(df: DataFrame, by: str) -> list[str | None]:
    """The values of ``by``, each of which gets a model; NULL is one, and comes last."""
    rows = df.select(by).distinct().collect()
    return sorted((r[0] for r in rows), key=lambda g: (g is None, g or ""))


def _of_group(by: str, g: str | None) -> Column:
    return F.col(by).eqNullSafe(F.lit(g))


def _assembled(df: DataFrame, features: list[str], label: str, weight: str | None) -> DataFrame:
    safe = {f: f"__x{i}" for i, f in enumerate(features)}
    out = df.withColumns(
        {**{s: F.col(f"`{f}`").cast("double") for f, s in safe.items()}, "__y": F.col(label).cast("double")}
    ).withColumn("__w", (F.col(weight) if weight else F.lit(1.0)).cast("double"))
    return VectorAssembler(inputCols=list(safe.values()), outputCol="__v").transform(out)


def train_boosted_trees(
    df: DataFrame, *, features: list[str], label: str, by: str, weight: str | None = None, rounds: int = 20,
    depth: int = 4, step: float = 0.1, seed: int = 42,
) -> dict[str, Model]:
    models = {}
    for g in _groups(df, by):
        data = _assembled(df.where(_of_group(by, g)), features, label, weight)
        models[g] = GBTClassifier(
            featuresCol="__v", labelCol="__y", weightCol="__w", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed
        ).fit(data)
    return models


def train_mlp(
    df: DataFrame, *, features: list[str], label: str, by: str, hidden: tuple[int, ...] = (16,), max_iter: int = 50,
    seed: int = 42,
) -> dict[str, Model]:
    """Multilayer perceptron per group; there is no dropout or batch normalisation in Spark ML."""
    models = {}
    for g in _groups(df, by):
        data = _assembled(df.where(_of_group(by, g)), features, label, None)
        models[g] = MultilayerPerceptronClassifier(
            featuresCol="__v", labelCol="__y", layers=[len(features), *hidden, 2], maxIter=max_iter, seed=seed
        ).fit(data)
    return models


def score_models(df: DataFrame, models: dict[str, Model], *, features: list[str], label: str, by: str) -> DataFrame:
    """Attack probability from the model of each row's group; a row whose group has none stays, with a NULL score."""
    data = _assembled(df, features, label, None)
    known = F.lit(False)
    for g in models:
        known = known | _of_group(by, g)
    out = df.where(~known).withColumn("score_attack", F.lit(None).cast("double"))
    for g, model in models.items():
        scored = model.transform(data.where(_of_group(by, g)))
        scored = scored.withColumn("score_attack", F.get(vector_to_array("probability"), F.lit(1)))
        out = out.unionByName(scored.select(*df.columns, "score_attack"))
    return out


def feature_importance(spark, models: dict[str, Model], *, features: list[str]) -> DataFrame:
    """Gain-based importance of tree models, one row per group and feature."""
    rows = [(g, f, float(m.featureImportances[i])) for g, m in models.items() for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "protocol string, feature string, gain double")


# ---- stumps -------------------------------------------------------------------------------------------------------


def _stump_hit(stump: dict) -> Column:
    above = F.col(f"`{stump['feature']}`") >= F.lit(stump["threshold"])
    return above if stump["polarity"] > 0 else ~above


def stump_table(df: DataFrame, *, features: list[str], label: str, weight: Column | None = None) -> DataFrame:
    """Weighted error of the class-mean midpoint stump of every feature and polarity.

    Two wide aggregates: class means first, then errors against the resulting thresholds.
    """
    w = weight if weight is not None else F.lit(1.0)
    y = F.col(label)
    aggs = [F.sum(w).alias("w")]
    for i, f in enumerate(features):
        for k in (0, 1):
            mine = F.when(y == k, w)
            aggs.append((F.sum(mine * F.col(f"`{f}`")) / F.sum(mine)).alias(f"m{k}_{i}"))
    means = df.agg(*aggs).first()
    cuts = {
        f: 0.5 * (means[f"m0_{i}"] + means[f"m1_{i}"])
        for i, f in enumerate(features)
        if means[f"m0_{i}"] is not None and means[f"m1_{i}"] is not None
    }
    errs = [
        (F.sum(F.when((F.col(f"`{f}`") >= F.lit(t)) != (y == 1), w).otherwise(F.lit(0.0))) / F.sum(w)).alias(f"e{i}")
        for i, (f, t) in enumerate(cuts.items())
    ]
    cells = []
    for i, (f, t) in enumerate(cuts.items()):
        for order, polarity in ((0, 1), (1, -1)):
            e = F.col(f"e{i}") if polarity > 0 else F.lit(1.0) - F.col(f"e{i}")
            cells.append(
                F.struct(
                    F.lit(f).alias("feature"),
                    F.lit(t).alias("threshold"),
                    F.lit(polarity).alias("polarity"),
                    e.alias("error"),
                    F.lit(features.index(f) * 2 + order).alias("tie"),
                )
            )
    return df.agg(*errs).select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def best_stump(df: DataFrame, *, features: list[str], label: str, weight: Column | None = None) -> DataFrame:
    """Least weighted error; earlier features and the upward polarity win ties."""
    return stump_table(df, features=features, label=label, weight=weight).orderBy("error", "tie").limit(1).drop("tie")


def adaboost_stumps(df: DataFrame, *, features: list[str], label: str, rounds: int = 20) -> list[dict]:
    """Boosted stumps. A row's weight is an expression of the stumps so far, so nothing is stored between rounds."""
    stumps: list[dict] = []
    for _ in range(rounds):
        weight = None
        if stumps:
            agree = F.lit(0.0)
            for s in stumps:
                same = _stump_hit(s) == (F.col(label) == 1)
                agree = agree + F.when(same, F.lit(-s["alpha"])).otherwise(F.lit(s["alpha"]))
            weight = F.exp(agree)
        row = best_stump(df, features=features, label=label, weight=weight).first()
        err = min(max(row["error"], 1e-8), 0.499999)
        stumps.append(
            {
                "feature": row["feature"],
                "threshold": row["threshold"],
                "polarity": row["polarity"],
                "alpha": 0.5 * math.log((1.0 - err) / err),
            }
        )
    return stumps


def adaboost_score(stumps: list[dict]) -> Column:
    """The chance of an attack that the stumps' weighted vote says."""
    total = F.lit(0.0)
    for s in stumps:
        total = total + F.when(_stump_hit(s), F.lit(s["alpha"])).otherwise(F.lit(-s["alpha"]))
    return sigmoid(F.lit(2.0) * total)


# ---- tuning and blending ------------------------------------------------------------------------------------------


def tune_trials(
    train: DataFrame, val: DataFrame, *, features: list[str], label: str, by: str, max_fpr: float, coarse: int = 3,
    refine: int = 2, seed: int = 42,
) -> DataFrame:
    """Random regularisation trials, then mutations of the best one; every fit and evaluation is a Spark job."""
    rng = random.Random(seed)
    rows, best = [], None
    for trial in range(coarse + refine):
        if trial < coarse or best is None:
            stage, reg = "coarse", math.exp(rng.uniform(math.log(1e-5), math.log(1e-1)))
        else:
            stage, reg = "refine", min(1e-1, max(1e-6, best[1] * math.exp(rng.uniform(-0.7, 0.7))))
        try:  # a fit that fails is a row of the report, like any other; a wrong column or plan is not
            models = train_logistic(train, features=features, label=label, by=by, reg=reg, max_iter=25)
            cols = {f: F.col(f"`{f}`") for f in features}
            score = F.lit(None).cast("double")
            for g, m in models.items():
                score = F.when(_of_group(by, g), m.score(cols)).otherwise(score)
            scored = val.select(F.lit(GLOBAL_SCOPE).alias("scope"), F.col(label), score.alias("score"))
            points = roc_points(scored.where(F.col("score").isNotNull()), by="scope", score="score", label=label)
            obj = float(validation_objective(points, max_fpr).first()["objective"])
            status = "ok"
        except (ArithmeticError, IllegalArgumentException, ValueError) as exc:
            obj, status = float("nan"), f"failed: {type(exc).__name__}"
        if status == "ok" and (best is None or obj > best[0]):
            best = (obj, reg)
        rows.append((trial, stage, status, obj, json.dumps({"regParam": reg})))
    return train.sparkSession.createDataFrame(
        rows, "trial int, stage string, status string, objective double, params_json string"
    )


def dirichlet_weights(models: list[str], trials: int, seed: int) -> list[dict[str, float]]:
    """Random convex weights, with the even blend first."""
    rng = random.Random(seed)
    out = [{m: 1.0 / len(models) for m in models}]
    for _ in range(max(0, trials - 1)):
        draw = [rng.gammavariate(1.0, 1.0) for _ in models]
        out.append({m: d / sum(draw) for m, d in zip(models, draw)})
    return out


def blend_scores(df: DataFrame, *, scores: list[str], weights: list[dict[str, float]], keep: list[str]) -> DataFrame:
    """One row per row and blend: ``(keep..., blend_id, score)``."""
    cells = []
    for i, w in enumerate(weights):
        total = F.lit(0.0)
        for s in scores:
            total = total + F.lit(float(w[s])) * F.col(s)
        cells.append(F.struct(F.lit(i).alias("blend_id"), total.alias("score")))
    return df.select(*keep, F.explode(F.array(*cells)).alias("b")).select(*keep, "b.*")


def weighted_ensemble(
    df: DataFrame, *, scores: list[str], label: str, weights: list[dict[str, float]], max_fpr: float
) -> DataFrame:
    """Validation objective of every blend; the best one ranks first."""
    long = blend_scores(df, scores=scores, weights=weights, keep=[label])
    points = roc_points(
        long.withColumn("blend", F.col("blend_id").cast("string")), by="blend", score="score", label=label
    )
    out = validation_objective(points, max_fpr)
    return out.withColumn("blend_id", F.col("scope").cast("int")).drop("scope").orderBy(F.col("objective").desc(), "blend_id")
