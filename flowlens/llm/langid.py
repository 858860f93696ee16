"""Language ID: the mean of hashed subword embeddings, a linear softmax, a temperature and a rejection threshold."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import fold_of, small_batches, whole_text, windows_of
from flowlens.plans.small import cut_lineage, small_enough

UNDETERMINED = "und"
PIECE = 1 << 20  # characters that are hashed at once
GRAMS = (2, 3, 4)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point, whether it is a letter; made once per Python worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def subwords(piece: str, first: bool, last: bool, buckets: int) -> np.ndarray:
    """Buckets of the letter n-grams of a lower-cased piece; a word's ends count as a sign. ``pieces`` cuts one whole text."""
    codes = np.frombuffer(("\0" + piece + "\0").encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[np.minimum(codes, 0x10FFFF)]
    codes = np.where(is_letter, codes, np.uint32(0))
    found = []
    size = min(PIECE, len(codes) - 1)
    for n in GRAMS:
        m = len(codes) - n + 1
        if m < 1:
            continue
        key = np.full(m, n, np.uint32)
        for i in range(n):
            key *= np.uint32(0x01000193)
            key ^= codes[i : m + i] * np.uint32(0x9E3779B1)
        inner = is_letter[1 : m + 1] if n < 4 else is_letter[1 : m + 1] & is_letter[2 : m + 2]
        ok = is_letter[:m] | is_letter[1 : m + 1] if n == 2 else inner.copy()
        if not first:
            ok[:1] = False
        if not last:
            ok[size + 1 :] = False
        key = key[ok]
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x85EBCA6B)
        found.append((key >> np.uint32(8)) % np.uint32(buckets))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def pieces(text: str) -> Iterator[tuple[str, bool, bool]]:
    """Windows of the lower-cased text, which may be longer than the text."""
    text, overlap = text.lower(), max(GRAMS) - 1
    for start, piece in windows_of(text, PIECE, overlap):
        yield piece, start == 0, start + PIECE >= len(text)


@dataclass
class LanguageModel:
    """``table``: for each bucket its embedding times the softmax weights, so that a text is scored by one mean of rows."""

    langs: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    temperature: float = 1.0
    reject_below: float = 0.0

    def predict(self, text: str) -> tuple[str, float, bool]:
        total, count = np.zeros(len(self.langs)), 0
        for piece, first, last in pieces(text):
            found = subwords(piece, first, last, len(self.table))
            if 4 * len(found) > len(self.table):
                total += np.bincount(found, minlength=len(self.table)) @ self.table.astype(np.float64)
            else:
                total += self.table[found].sum(axis=0, dtype=np.float64)
            count += len(found)
        if not count or not self.langs:
            return UNDETERMINED, 0.0, True
        p = softmax(((total / count) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.reject_below)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def features(text: str, key: int, buckets: int, snippets: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """The whole text, and some short runs of its words: (whole, buckets, shares)."""
    words = text.split()
    rng = np.random.default_rng(key & 0x7FFFFFFF)
    parts = [(True, text)]
    for i in range(snippets if words else 0):
        n = (2, 6, 16)[i % 3]
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        parts.append((False, " ".join(words[at : at + n])))
    for whole, part in parts:
        counts = np.zeros(buckets, np.int64)
        for piece, first, last in pieces(part):
            counts += np.bincount(subwords(piece, first, last, buckets), minlength=buckets)
        if total := counts.sum():
            hit = counts.nonzero()[0]
            yield whole, hit.astype(np.int32), (counts[hit] / total).astype(np.float32)


def sample_features(train: DataFrame, per_lang: int, buckets: int, snippets: int, seed: int) -> DataFrame:
    """Features of at most about ``per_lang`` documents of each language, the lowest by a stable hash, whole texts."""
    # one row a language: the texts stay where they are and are not dealt by language
    counts = small_enough(cut_lineage(train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n"))
    picked = (
        train.join(counts, "lang")
        .withColumn("key", key)
        .where(F.pmod("key", F.lit(1 << 40)) / F.lit(float(1 << 40)) < share)
        .select("lang", "key", "text")
    )

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (lang, int(key), whole, hit.tobytes(), shares.tobytes())
                for lang, key, text in zip(batch["lang"], batch["key"], batch["text"], strict=True)
                for whole, hit, shares in features(text, int(key), buckets, snippets)
            ]
            yield pd.DataFrame(rows, columns=["lang", "key", "whole", "hit", "shares"])

    return picked.mapInPandas(extract, "lang string, key long, whole boolean, hit binary, shares binary")


def fit(
    docs: DataFrame,
    per_lang: int = 500,
    buckets: int = 1 << 14,
    width: int = 16,
    epochs: int = 6,
    rate: float = 0.5,
    snippets: int = 3,
    keep: float = 0.999,
    seed: int = 7,
) -> LanguageModel:
    """Train on documents with a ``lang`` and at least one letter.

    The sample is bounded by ``per_lang`` whole documents of each language (chosen by a stable hash over all of them), so
    the one task that trains holds at most that many feature rows, and the driver the model alone. A fifth of them, not
    trained on, sets the temperature and the rejection threshold: whole documents of known languages are kept with a share of ``keep`` at least. No usable row
    gives a model that answers ``und``.
    """
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    found = sample_features(small_batches(train), per_lang, buckets, snippets, seed)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            model = trained(pd.concat(parts, ignore_index=True), buckets, width, epochs, rate, keep, seed)
            parts = model.langs, model.table, model.bias, model.temperature, model.reject_below
            yield pd.DataFrame([(pickle.dumps(parts),)], columns=["model"])

    made = found.repartition(1).mapInPandas(learn, "model binary").collect()
    return LanguageModel(*pickle.loads(made[0]["model"])) if made else LanguageModel(table=np.zeros((buckets, 0), np.float32))


def trained(got: pd.DataFrame, buckets: int, width: int, epochs: int, rate: float, keep: float, seed: int) -> LanguageModel:
    """The model of the sample's features, whatever their order."""
    got = got.sort_values(["key", "whole", "lang", "hit"], ignore_index=True)
    langs = sorted(got["lang"].unique())
    y = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    hits = [np.frombuffer(b, np.int32) for b in got["hit"]]
    shares = [np.frombuffer(b, np.float32) for b in got["shares"]]
    held = (got["key"].to_numpy() >> 45) % 5 == 0
    if held.all() or not held.any():
        held[:] = False
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (buckets, width)).astype(np.float32)
    weights = rng.normal(0, 0.1, (width, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    rows = np.flatnonzero(~held)
    freq = np.bincount(y[rows], minlength=len(langs))
    cost = (len(rows) / np.maximum(1, freq) / len(langs)).clip(0.2, 5.0)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for r in rng.permutation(rows):
            hit, share = hits[r], shares[r]
            mean = share @ embed[hit]
            slope = softmax(mean @ weights + bias)
            slope[y[r]] -= 1
            slope *= cost[y[r]]
            back = weights @ slope
            weights -= step * np.outer(mean, slope)
            bias -= step * 0.1 * slope
            # a text's share of one bucket is tiny: the step is scaled so that its buckets move as one
            embed[hit] -= (step / max(1e-6, float(share @ share))) * np.outer(share, 0.2 * back)
    model = LanguageModel(langs, (embed @ weights).astype(np.float32), bias)
    judged = np.flatnonzero(held) if held.any() else rows
    logits = np.array([s @ model.table[h] for h, s in zip((hits[r] for r in judged), (shares[r] for r in judged), strict=True)])
    logits = logits + model.bias
    grid = np.geomspace(0.1, 10.0, 41)
    loss = [-np.log(softmax(logits / t)[np.arange(len(judged)), y[judged]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    whole = got["whole"].to_numpy()[judged]
    top = softmax(logits / model.temperature).max(axis=1)[whole]
    # never above half: a language that is likelier than all others together is not rejected
    model.reject_below = float(min(0.5, np.quantile(top, 1 - keep))) if len(top) else 0.0
    return model


PREDICTION = "lang_pred string, score double, rejected boolean"


def predictions(text: Column, model: LanguageModel) -> Column:
    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict(whole_text(text))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: ``lang_pred``, ``score`` and ``rejected`` of each whole text.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. Very long texts are hashed piece by piece
    and count whole. Repeated rows get repeated results, an empty table an empty one; a column named as ``into`` is
    replaced, all others pass through and none but the text is read.
    """
    return small_batches(docs).withColumn(into, predictions(F.col(text), model))


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from: ``crc32(doc_id as text) mod 4`` is not 2."""
    return docs.where(fold_of("doc_id", 4) != 2)
