"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import fold_of, unit_hash, whole_text
from flowlens.plans.small import cut_lineage

STATS = [
    "log_words", "word_length", "symbol_share", "table_share", "digit_share", "upper_share", "mark_share", "stop_share",
    "distinct_words", "top_word", "repeat_next", "repeat_lines", "line_words", "odd_bytes",
]
SYMBOL_BYTES = np.frombuffer(b"#*$%&<>@^~\\{}[]=_", np.uint8)
MARK_BYTES = np.frombuffer(b"!?;:()\"", np.uint8)
STOP_BYTES = np.frombuffer(b".,", np.uint8)


def statistics(text: str) -> tuple[float, ...]:
    """Statistics of one whole text; an empty one gives zeros."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    histogram = np.zeros(256, np.int64)
    for start in range(0, len(raw), 1 << 20):
        histogram += np.bincount(np.frombuffer(raw, np.uint8, min(1 << 20, len(raw) - start), start), minlength=256)
    chars = len(text)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same_next = sum(map(bytes.__eq__, words[1:], words))
    return (
        math.log1p(n),
        min(20.0, (chars - n) / n),
        min(2.0, float(histogram[SYMBOL_BYTES].sum()) / n),
        min(2.0, float(histogram[124]) / n),
        float(histogram[48:58].sum()) / chars,
        float(histogram[65:91].sum()) / chars,
        min(2.0, float(histogram[MARK_BYTES].sum()) / n),
        min(2.0, float(histogram[STOP_BYTES].sum()) / n),
        len(counts) / n,
        max(counts.values()) / n if n > 4 else 0.0,
        same_next / n,
        1.0 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        float(histogram[:9].sum() + histogram[14:32].sum()) / chars,
    )


@dataclass
class QualityModel:
    """``score = calibrate(weights . sqrt(2 / D) cos(W x + b))`` of the standardised statistics ``x``."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5]))

    def project(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8.0, 8.0)
        z = np.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.project(stats) @ self.weights if self.weights is not None else np.zeros(len(stats))

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def isotonic(raw: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots at the blocks' mean raw scores, so that the line between them keeps the order."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of raw, sum of target, count
    values, start = raw[order], 0
    while start < len(values):
        stop = start + int(np.searchsorted(values[start:], values[start], side="right"))
        blocks.append([float(values[start:stop].sum()), float(target[order[start:stop]].sum()), float(stop - start)])
        start = stop
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """Statistics and mean label of at most about ``max_rows`` labelled documents, spread by a stable hash."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    total = known.count()
    share = min(1.0, max_rows / total) if total else 0.0
    picked = (
        known.where(unit_hash(F.col("doc_id"), seed=seed) < share)
        .groupBy("doc_id")
        .agg(F.avg(F.col("quality").cast("double")).alias("y"))
    )
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    joined = texts.join(F.broadcast(picked), "doc_id")  # at most about max_rows rows of two numbers

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "x": [np.array(statistics(t or "")).tobytes() for t in batch["text"]],
                    "y": batch["y"],
                    "fold": batch["fold"],
                }
            )

    return joined.select("text", "y", (F.floor(unit_hash(F.col("doc_id"), seed=seed + 1) * 10)).cast("int").alias("fold")).mapInPandas(
        extract, "x binary, y double, fold int"
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 30_000,
    width: int = 384,
    gamma: float = 0.05,
    ridge: float = 1e-3,
    partitions: int = 16,
    seed: int = 11,
) -> QualityModel:
    """Fit on ``labels.quality`` of documents whose ``crc32(doc_id as text) mod 5`` is not 0.

    The labelled sample is bounded by ``max_rows``; each of ``partitions`` tasks sums the normal equations of its rows,
    ``(width + 1)`` squared, and the driver adds those few matrices. Seven tenths fit the ridge weights; the rest, which
    the weights have not seen, give the isotonic levels. Repeated labels of an id are averaged, null labels and ids are
    left out, and without any usable label every score is 0.5.
    """
    rows = labelled_statistics(docs.where(fold_of("doc_id", 5) != 0), labels.where(fold_of("doc_id", 5) != 0), max_rows, seed)
    rows = cut_lineage(rows.repartition(partitions))
    rng = np.random.default_rng(seed)
    d = len(STATS)
    model = QualityModel(
        mean=np.zeros(d),
        scale=np.ones(d),
        directions=rng.normal(0, math.sqrt(2 * gamma), (d, width)),
        phases=rng.uniform(0, 2 * math.pi, width),
    )
    n, total, squares = summed(rows, lambda x, y: (np.array(float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)), 3)
    if n is None:
        return model
    model.mean = total / n
    spread = np.sqrt(np.maximum(squares / n - model.mean**2, 0.0))
    model.scale = np.where(spread > 1e-9, spread, 1.0)

    def normal(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        z = model.project(x)
        return z.T @ z, z.T @ y

    gram, target = summed(rows.where("fold < 7"), normal, 2)
    if gram is None:
        gram, target = summed(rows, normal, 2)
    model.weights = np.linalg.solve(gram + ridge * float(n) / width * np.eye(len(gram)), target)
    judged = rows.where("fold >= 7").toPandas()
    if judged.empty:
        judged = rows.toPandas()
    judged = judged.sort_values(["x", "y"], ignore_index=True)
    model.knots, model.levels = isotonic(model.raw(unpacked(judged["x"])), judged["y"].to_numpy())
    return model


def unpacked(cells: pd.Series) -> np.ndarray:
    return np.array([np.frombuffer(b) for b in cells]).reshape(len(cells), len(STATS))


def summed(rows: DataFrame, terms, n_terms: int) -> list:
    """Add ``terms(x, y)`` over all rows: within each partition first, then over the partitions. None for no rows."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for batch in batches:
            if len(batch):
                new = terms(unpacked(batch["x"]), batch["y"].to_numpy())
                sums = new if sums is None else tuple(a + b for a, b in zip(sums, new, strict=True))
        if sums is not None:
            yield pd.DataFrame({"term": range(len(sums)), "cells": [np.asarray(s, float).tobytes() for s in sums]})

    out: list = [None] * n_terms
    got = rows.mapInPandas(partial, "term int, cells binary").toPandas().sort_values(["term", "cells"])
    for term, cells in zip(got["term"], got["cells"], strict=True):
        part = np.frombuffer(cells)
        out[term] = part if out[term] is None else out[term] + part
    if out[0] is None:
        return out
    return [x.reshape(math.isqrt(len(x)), -1) if i == 0 and n_terms == 2 else x if len(x) > 1 else float(x[0]) for i, x in enumerate(out)]


def scores(text: Column, model: QualityModel) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATS))))

    return score(whole_text(text))


def grade(docs: DataFrame, model: QualityModel, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``, the calibrated chance that a text is good. Only the text is read.

    A null text counts as empty; an empty text has statistics of zero and the score that the model gives them. Repeated
    rows get repeated scores, an empty table an empty one; a column named as ``into`` is replaced.
    """
    return docs.withColumn(into, scores(F.col(text), model))
