"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import fresh, row_hash, small_batches, whole_text
from flowlens.llm.components import apart
from flowlens.plans.small import cut_lineage, small_enough

WORDS = re.compile(r"\w+")
LEAST = 5  # words of the shortest match
COVERAGE = 0.5  # share of a test's words that must be found
FILTER_BITS = 1 << 23
KNOWN = 100_000  # words whose hashes a task keeps at once
BASE = np.uint64(0x9E3779B97F4A7C15)


class TokenHashes(dict):
    """Words to 64-bit hashes, kept for the next text; emptied when it holds too many words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 0) | 1
        return value

    def of(self, text: str) -> np.ndarray:
        words = WORDS.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def karp_rabin(tokens: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of ``size`` tokens, modulo 2 ** 64."""
    n = len(tokens) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        if size <= 16:
            for i in range(size):
                out = out * BASE + tokens[i : n + i]
            return out
        half = size // 2  # a window is two halves, so that a long one takes few passes
        left, right = karp_rabin(tokens, half), karp_rabin(tokens, size - half)
        power = np.uint64(pow(int(BASE), size - half, 1 << 64))
        return left[:n] * power + right[half : n + half]


def probes(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return (grams >> np.uint64(3)) & mask, (grams >> np.uint64(33)) & mask


def tile(text: np.ndarray, test: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles ``(place in text, place in test, words)``: again and again the longest match of words not yet in a tile.

    Matches of a search length are found by hash, checked word by word and grown; a match over twice that length
    restarts the search there, else the length is halved down to ``least``. Ties go to the earlier place in the
    text, then in the test. A token 0 matches nothing.
    """
    in_text, in_test = np.zeros(len(text), bool), np.zeros(len(test), bool)
    in_text |= text == 0
    tiles: list[tuple[int, int, int]] = []

    def grown(t: int, p: int) -> int:
        n = 0
        while t + n < len(text) and p + n < len(test) and text[t + n] == test[p + n] and not in_text[t + n] and not in_test[p + n]:
            n += 1
        return n

    size = max(least, min(len(text), len(test), 64))
    while True:
        places: dict[int, list[int]] = {}
        for p, h in enumerate(karp_rabin(test, size).tolist()):
            if not in_test[p : p + size].any():
                places.setdefault(h, []).append(p)
        found: list[tuple[int, int, int]] = []
        if places:
            hashes = karp_rabin(text, size)
            hit = np.flatnonzero(np.isin(hashes, np.fromiter(places, np.uint64, len(places))))
            for t in hit.tolist():
                for p in places[int(hashes[t])]:
                    before = t and p and text[t - 1] == test[p - 1] and not in_text[t - 1] and not in_test[p - 1]
                    if not before and (n := grown(t, p)) >= size:
                        found.append((n, t, p))
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        blocked = False
        for n, t, p in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if in_text[t : t + n].any() or in_test[p : p + n].any():
                blocked = True
                continue
            in_text[t : t + n] = True
            in_test[p : p + n] = True
            tiles.append((t, p, n))
        if in_test.all():
            break
        if blocked:
            continue
        if size == least:
            break
        size = max(least, size // 2)
    return tiles


def tests_of(benchmark: DataFrame) -> DataFrame:
    """``(test, item_id, n_items, tokens)``: each distinct word sequence once, with the smallest of its ids.

    Items of fewer than five words, null texts included, are no evidence of a leak and are left out.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = TokenHashes()
        for batch in batches:
            tokens = [known.of(t) for t in batch["text"]]
            keep = [i for i, x in enumerate(tokens) if len(x) >= LEAST]
            yield pd.DataFrame(
                {
                    "test": [xxhash.xxh64_intdigest(tokens[i].tobytes(), 1) >> 1 for i in keep],
                    "item_id": batch["item_id"].iloc[keep].astype("Int64").to_numpy(dtype=object, na_value=None),
                    "tokens": pd.Series([tokens[i].view(np.int64) for i in keep], dtype=object),
                }
            )

    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    rows = items.mapInPandas(hashed, "test long, item_id long, tokens array<long>")
    return cut_lineage(
        rows.groupBy("test").agg(
            F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"), F.first("tokens").alias("tokens")
        )
    )


def grams_of(tests: DataFrame) -> DataFrame:
    """``(test, gram, times)``: the hashed five-word runs of each test."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [karp_rabin(np.asarray(x, np.int64).view(np.uint64), LEAST).view(np.int64) for x in batch["tokens"]]
            counts = np.array([len(g) for g in grams], np.int64)
            yield pd.DataFrame({"test": np.repeat(batch["test"].to_numpy(), counts), "gram": np.concatenate([*grams, np.empty(0, np.int64)])})

    rows = tests.select("test", "tokens").mapInPandas(windows, "test long, gram long")
    return cut_lineage(rows.groupBy("test", "gram").agg(F.count(F.lit(1)).alias("times")))


def seed_filter(grams: DataFrame, partitions: int = 8) -> np.ndarray:
    """A Bloom filter of all five-word runs of the tests, of a fixed size; each of ``partitions`` tasks fills one."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for place in probes(batch["gram"].to_numpy(np.int64).view(np.uint64)):
                seen[place] = True
        yield pd.DataFrame({"bits": [np.packbits(seen, bitorder="little").tobytes()]})

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for cells in grams.select("gram").repartition(partitions).mapInPandas(bits, "bits binary").toLocalIterator():
        out |= np.frombuffer(cells[0], np.uint8)
    return out


SUSPECTS = "row long, doc_id long, starts array<int>, runs array<array<long>>, grams array<long>"


def suspects(docs: DataFrame, seeds: np.ndarray) -> DataFrame:
    """Documents with a five-word run that the filter knows: the runs' words as hashes, and their distinct windows."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = TokenHashes()
        for batch in batches:
            rows = []
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                tokens = known.of(text)
                grams = karp_rabin(tokens, LEAST)
                hit = np.ones(len(grams), bool)
                for place in probes(grams):
                    hit &= (seeds[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not hit.any():
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                starts, stops = edges[::2], edges[1::2] + LEAST - 1
                runs = [tokens[a:b].view(np.int64) for a, b in zip(starts, stops, strict=True)]
                found = np.unique(grams[hit]).view(np.int64)
                rows.append((row, None if pd.isna(doc_id) else int(doc_id), starts.astype(np.int32), runs, found))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "starts", "runs", "grams"])

    return docs.mapInPandas(scan, SUSPECTS)


FINDINGS = (
    "row long, doc_id long, item_id long, n_items long, item_words int, covered_words int, coverage double, tiles string"
)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """One row for each document and test of which the tiles cover a share of ``coverage`` of the words or more.

    Words are runs of letters, digits and underscores in lower case. The tests are the query set: a filter of fixed size
    picks the documents that may share a five-word run with one, those runs are joined with the tests' runs, and a pair is
    tiled only if the runs it shares could reach the coverage. Tiles may lie in any order in the document. ``tiles``
    lists ``place in document:place in test:words`` by place in the test. Tests of the same words count as one, with
    ``n_items`` and the smallest ``item_id``; repeated rows of a document count as one. Null or empty texts have no row,
    nor have empty tables; extra columns are not read.
    """
    tests = tests_of(benchmark)
    grams = grams_of(tests)
    seeds = seed_filter(grams)
    source = small_batches(docs).select(row_hash(text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    found = cut_lineage(suspects(source, seeds))
    shared = found.select("row", F.explode("grams").alias("gram")).distinct()
    sizes = tests.select(F.col("test").alias("__test"), F.size("tokens").alias("words"))
    pairs = (
        shared.join(grams.select("test", "times", apart("gram").alias("g")), F.col("gram") == F.col("g"))
        .groupBy("row", "test")
        .agg(F.sum("times").alias("runs"))
        .join(sizes, F.col("test") == F.col("__test"))
        .where(F.col("runs") * LEAST >= F.ceil(F.col("words") * F.lit(coverage)))
        .select("row", "test")
    )
    pairs = pairs.join(tests.select(apart("test").alias("__test"), "item_id", "n_items", "tokens"), F.col("test") == F.col("__test"))
    texts = found.dropDuplicates(["row"]).select(apart("row").alias("__row"), "doc_id", "starts", "runs")
    pairs = pairs.join(texts, F.col("row") == F.col("__row")).select(
        "row", "doc_id", "item_id", "n_items", "tokens", "starts", "runs"
    )

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, doc_id, item_id, n_items, tokens, starts, runs in batch.itertuples(index=False):
                test = np.asarray(tokens, np.int64).view(np.uint64)
                parts, places = [], []
                for start, run in zip(starts, runs, strict=True):
                    parts += [np.asarray(run, np.int64).view(np.uint64), np.zeros(1, np.uint64)]
                    places.append(np.arange(start, start + len(run) + 1))
                tiles = sorted(tile(np.concatenate(parts), test), key=lambda x: x[1])
                where = np.concatenate(places)
                n = sum(x[2] for x in tiles)
                if n >= coverage * len(test):
                    said = ",".join(f"{where[t]}:{p}:{m}" for t, p, m in tiles)
                    ids = [None if pd.isna(x) else int(x) for x in (doc_id, item_id)]
                    rows.append((row, *ids, n_items, len(test), n, n / len(test), said))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINDINGS.split(", ")])

    return pairs.mapInPandas(cover, FINDINGS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """``docs`` without the rows that leak a test; all columns pass through. See ``leaks``."""
    key, leak = fresh(docs, "__row"), fresh(docs, "__leak")
    bad = cut_lineage(leaks(docs, benchmark, coverage, text).select(F.col("row").alias(leak)).distinct())
    return docs.withColumn(key, row_hash(text)).join(small_enough(bad), F.col(key) == F.col(leak), "left_anti").drop(key)
