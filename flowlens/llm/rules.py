"""Quality rules by compression: how well zstandard packs a whole document and each of its fixed chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import fresh, whole_text

SYMBOLS = re.compile(r"[#*$%&|<>]")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Bands:
    """Allowed ratios of packed to raw bytes.

    ``whole`` holds ``(bytes up to, lowest, highest)``: short texts pack badly and get a higher band. Chunks of
    ``chunk_bytes`` all have one length, and so one band; the last, shorter one is judged by the band of its length
    if it has ``least_bytes``. A document may have ``bad_chunks`` as a share of its chunks outside their band.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (512, 0.26, 1.00),
        (1024, 0.26, 0.85),
        (4096, 0.24, 0.75),
        (16384, 0.22, 0.70),
        (float("inf"), 0.20, 0.68),
    )
    chunk_bytes: int = 4096
    least_bytes: int = 256
    bad_chunks: float = 0.25
    level: int = 3

    def of(self, size: int) -> tuple[float, float]:
        return next((lo, hi) for top, lo, hi in self.whole if size <= top)


RULES_TYPE = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, n_chunks long, n_bad_chunks long, lowest_chunk double, highest_chunk double, verdict string"
)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """How many words lie in a ``window``-word run that the text has twice or more, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    key = ids[:n].copy()
    for i in range(1, window):
        key = key * len(numbers) + ids[i : n + i]
        if len(numbers) ** 2 * n >= 1 << 62 or i < window - 1 and len(numbers) >= 1 << 20:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    inside = np.zeros(len(words), bool)
    for i in range(window):
        inside[i : n + i] |= twice
    return int(inside.sum())


def measure(text: str, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes split at space and \x09-\x0D only
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [line for line in raw.split(b"\n") if line.strip()] if b"\n" in raw else []
    size = len(raw)
    ratio = len(packer.compress(raw)) / size if size else None
    bad, seen, chunks = 0, [], 0
    if size > bands.chunk_bytes:
        view = memoryview(raw)
        for start in range(0, size, bands.chunk_bytes):
            piece = view[start : start + bands.chunk_bytes]
            if len(piece) < bands.least_bytes:
                continue
            chunks += 1
            seen.append(len(packer.compress(piece)) / len(piece))
            low, high = bands.of(len(piece))
            bad += not low <= seen[-1] <= high
    verdict = "empty"
    if size:
        low, high = bands.of(size)
        verdict = "repetitive" if ratio < low else "incompressible" if ratio > high else "ok"
        if verdict == "ok" and bad > bands.bad_chunks * chunks:
            verdict = "chunks"
    return (
        len(words), len(text) - spaces, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words),
        ratio, chunks, bad, min(seen, default=None), max(seen, default=None), verdict,
    )


def measures(text: Column, bands: Bands = Bands()) -> Column:
    """A struct of the counts, ratios and verdict of each whole text; see ``quality_rules``."""

    @F.pandas_udf(RULES_TYPE)
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        names = [c.split()[0] for c in RULES_TYPE.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure(t or "", bands, packer) for t in texts], columns=names)

    return rules(whole_text(text))


def quality_rules(docs: DataFrame, text: str = "text", into: str = "rules", bands: Bands = Bands()) -> DataFrame:
    """``docs`` with a struct ``into``: counts, compression ratios, ``verdict``, ``base_failed`` and ``kept``.

    A null text counts as empty: all counts 0, no ratio, verdict ``empty``, base_failed. One task holds one Arrow batch;
    a text is never cut for the whole ratio, and chunks are windows on its bytes. Repeated rows get repeated results; an
    empty table gives an empty one; other columns pass through, one named as ``into`` is replaced.
    """
    kept = docs.drop(into)
    own = fresh(kept, "__rules")
    m = F.col(f"`{own}`")
    failed = (m.n_words < MIN_WORDS) | (m.n_repeat_words * 100 > m.n_words * MAX_REPEAT_PERCENT)
    return kept.withColumn(own, measures(F.col(text), bands)).select(
        *[F.col(f"`{c}`") for c in kept.columns],
        F.struct(f"{own}.*", failed.alias("base_failed"), (~failed & (m.verdict == "ok")).alias("kept")).alias(into),
    )
