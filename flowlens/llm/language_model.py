"""A trigram language model of the corpus: batches of word numbers meet sharded Elias-Fano tries and get log probabilities."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import small_batches, whole_text
from flowlens.llm.ngram_trie import ANY, Trie, merged, runs
from flowlens.plans.ordered import rank_rows
from flowlens.plans.small import cut_lineage

#: Numbers of what is no word: nothing before the start, the start, the end. Words follow by falling count.
NOTHING, START, END, WORDS = 0, 1, 2, 3
PAIRS, QUERIES, TEXTS = 0, 1, 2
FREQUENT = 1 << 16  # words whose counts are looked up at once
ROWS = 1 << 18  # tokens that are scored at once


@dataclass(frozen=True)
class Model:
    """``discount`` of absolute discounting; ``batch`` tokens are numbered together; a shard is made for about ``per_shard``
    tokens, which one task sorts in memory; up to ``max_shared`` words are handed to every task as 12 bytes each, more are
    joined."""

    discount: float = 0.75
    batch: int = 1 << 20
    per_shard: int = 2_000_000
    max_shared: int = 1 << 24


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2 ** 32, as planes of bytes."""
    planes = [np.asarray(a, np.int64).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    sizes = np.array([len(planes), *map(len, planes)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(planes))


def opened(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, "<i8", int(np.frombuffer(raw, "<i8", 1)[0]), 8)
    out, at = [], 8 + 8 * len(sizes)
    for size in sizes.tolist():
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(4, -1)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))
        at += size
    return out


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


BATCHES = "batch long, ids array<string>, texts binary, hashes binary, others binary"


def batches(docs: DataFrame, model: Model, seed: int) -> DataFrame:
    """Rows of ``(id, learn, text)`` as batches: ``texts`` holds who is learned from, lengths, and word numbers within the batch;
    then a hash of each distinct word, and with it a second one and how often the texts to learn from have the word."""

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        place, made = TaskContext.get().partitionId() << 32, itertools.count()
        ids, learn, texts, words, held = [], [], [], Numbers(), 0

        def batch() -> pd.DataFrame:
            lengths = np.array([len(t) for t in texts], np.int64)
            stream = np.concatenate(texts) if texts else np.zeros(0, np.int32)
            learned = np.repeat(np.array(learn, bool), lengths)
            times = np.bincount(stream[learned], minlength=len(words))
            digests = b"".join(xxhash.xxh3_128_digest(w, seed) for w in words)
            both = np.frombuffer(digests, "<u4").reshape(-1, 4)
            hashes, checks = np.ascontiguousarray(both[:, :2]).view("<i8").ravel(), both[:, 2]
            row = (place + next(made), ids, squeezed(learn, lengths, stream), hashes.tobytes(), squeezed(checks, times))
            return pd.DataFrame([row], columns=[x.split()[0] for x in BATCHES.split(", ")])

        for part in parts:
            for i, is_learned, text in zip(part["id"], part["learn"], part["text"], strict=True):
                found = text.encode("utf-8", "replace").lower().split()  # only A-Z change, only space and \x09-\x0D split
                texts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                ids.append(i)
                learn.append(bool(is_learned))
                held += len(found) + 1
                if held >= model.batch:
                    yield batch()
                    ids, learn, texts, words, held = [], [], [], Numbers(), 0
        if ids:
            yield batch()

    return docs.mapInPandas(number, BATCHES)


WORD_PARTS = "part int, hashes binary, others binary, clash boolean"


def numbered_words(stored: DataFrame) -> tuple[DataFrame, bool]:
    """``(part, hashes, others)`` of all words, with how often each is learned from, and whether two of them share a hash.

    Each batch's words are dealt out by hash, sorted, so that a task sums up one part of all words after another.
    """
    parts = 8 * int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for hashes, others in zip(batch["hashes"], batch["others"], strict=True):
                hashes, (checks, times) = np.frombuffer(hashes, "<i8"), opened(others)
                order = np.argsort(hashes)
                to = mixed(hashes[order]) % parts
                for part, at in split(to, parts):
                    own = order[at]
                    rows.append((part, hashes[own].tobytes(), squeezed(checks[own], times[own]), False))
            yield pd.DataFrame(rows, columns=["part", "hashes", "others", "clash"])

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            for part, hashes, others, _ in batch.itertuples(index=False):
                if held and part != now:
                    yield summed(now, held)
                    held = []
                now = part
                held.append((np.frombuffer(hashes, "<i8"), *opened(others)))
        if held:
            yield summed(now, held)

    def summed(part: int, held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        hashes, checks, times = (np.concatenate([x[i] for x in held]) for i in range(3))
        order = np.argsort(hashes, kind="stable")
        hashes, checks, times = hashes[order], checks[order], times[order]
        starts, sizes = runs(hashes)
        clash = bool((checks != np.repeat(checks[starts], sizes)).any())
        row = (part, hashes[starts].tobytes(), np.add.reduceat(times, starts).astype("<i8").tobytes(), clash)
        return pd.DataFrame([row], columns=["part", "hashes", "others", "clash"])

    dealt = stored.select("hashes", "others").mapInPandas(deal, WORD_PARTS)
    words = cut_lineage(dealt.repartition("part").sortWithinPartitions("part").mapInPandas(total, WORD_PARTS))
    return words, not words.where("clash").isEmpty()


def listed(parts: DataFrame, key: str, has_times: bool) -> DataFrame:
    """``(key, at, hash, times)``, one row for each word of packed ones."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, hashes, others in batch.itertuples(index=False):
                hashes = np.frombuffer(hashes, "<i8")
                times = np.frombuffer(others, "<i8") if has_times else np.zeros(len(hashes), np.int64)
                for at in range(0, len(hashes), 1 << 16):
                    h, t = hashes[at : at + (1 << 16)], times[at : at + (1 << 16)]
                    yield pd.DataFrame({"key": k, "at": np.arange(at, at + len(h)), "hash": h, "times": t})

    return parts.select(key, "hashes", "others").mapInPandas(rows, "key long, at int, hash long, times long")


def count_steps(words: DataFrame) -> list[tuple[int, int]]:
    """Falling counts and how many words have each: fewer than the square root of twice the tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for others in batch["others"]:
                times, n = np.unique(np.frombuffer(others, "<i8"), return_counts=True)
                yield pd.DataFrame({"times": times, "n": n})

    found = words.select("others").mapInPandas(count, "times long, n long").groupBy("times").agg(F.sum("n").alias("n"))
    return sorted(((r["times"], r["n"]) for r in found.collect()), reverse=True)


@dataclass(frozen=True)
class Corpus:
    """What every task knows: how often words of falling count occur (one entry for each distinct count: ``counts`` from word
    number ``firsts`` on), the sums, and into how many shards rows are dealt."""

    counts: np.ndarray
    firsts: np.ndarray
    ends: int
    tokens: int
    kinds: int
    shards: int
    per_shard: int
    copies: dict[int, int] = field(default_factory=dict)  # shards that several tasks make, each for a part of what is scored

    def searched(self, word: np.ndarray) -> np.ndarray:
        if not len(self.counts):
            return np.where(word == END, self.ends, 0)
        at = np.searchsorted(self.firsts, word, side="right") - 1
        return np.where(word == END, self.ends, np.where(word >= WORDS, self.counts[np.maximum(at, 0)], 0))

    @cached_property
    def frequent(self) -> np.ndarray:
        """Counts of the words that most tokens are."""
        return self.searched(np.arange(FREQUENT))

    def count(self, word: np.ndarray) -> np.ndarray:
        out = self.frequent[np.minimum(word, FREQUENT - 1)]
        rest = np.flatnonzero(word >= FREQUENT)
        out[rest] = self.searched(word[rest])
        return out

    def first_below(self, least: int) -> int:
        """From this number on words are learned from less often than ``least``."""
        at = int((self.counts >= least).sum())
        return int(self.firsts[at]) if at < len(self.firsts) else np.iinfo(np.int64).max

    def probability(self, word: np.ndarray) -> np.ndarray:
        return (self.count(word) + 1) / (self.tokens + self.kinds + 1)

    def spread(self, v: np.ndarray) -> np.ndarray:
        """Into how many shards the rows of a middle word go, by their earlier word."""
        out = np.ones(len(v), np.int64)
        often = np.flatnonzero((v >= WORDS) & (v < self.first_below(self.per_shard)))
        out[often] += self.count(v[often]) // self.per_shard
        return out

    def shard(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.bucket(v, mixed(u) % self.spread(v))

    def bucket(self, v: np.ndarray, part: np.ndarray) -> np.ndarray:
        return mixed(v * 1_000_003 + part) % self.shards


def mixed(x: np.ndarray) -> np.ndarray:
    z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((z ^ (z >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


@dataclass
class Rows:
    """The tokens of a batch, each with the two before it; ``doc`` numbers the texts."""

    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray, stream: np.ndarray) -> Rows:
        ends = np.cumsum(lengths + 3)
        line = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)  # nothing, start, words, end of each text
        word = np.ones(len(line), bool)
        starts = ends - lengths - 3
        for at, what in ((starts, NOTHING), (starts + 1, START), (ends - 1, END)):
            line[at], word[at] = what, False
        line[word] = stream
        token = np.ones(len(line), bool)
        token[starts] = token[starts + 1] = False
        at = np.flatnonzero(token)
        return cls(line[at - 2], line[at - 1], line[at], np.repeat(np.arange(len(lengths)), lengths + 1))


def counted(rows: Rows, which: np.ndarray) -> tuple[np.ndarray, ...]:
    return merged([(rows.v[which], rows.u[which], rows.w[which], np.ones(int(which.sum()), np.int64))])


SCATTERED = "shard int, salt int, kind int, batch long, ids array<string>, data binary"
COLUMNS = [x.split()[0] for x in SCATTERED.split(", ")]


def split(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each key below ``n``, in order."""
    order = np.argsort(keys, kind="stable")
    bounds = np.searchsorted(keys[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        yield k, order[bounds[k] : bounds[k + 1]]


def words_of(part: pd.DataFrame, known: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray]]:
    for row in part.to_dict("records"):
        learn, lengths, stream = opened(row["texts"])
        if known is None:
            numbers = np.asarray([] if row["numbers"] is None else row["numbers"], np.int64)  # no word in the batch: no list
        else:
            hashes = np.frombuffer(row["hashes"], "<i8")
            numbers = known[1][np.searchsorted(known[0], hashes)].astype(np.int64)
        yield row["batch"], row["ids"], learn.astype(bool), lengths, (numbers[stream] if len(stream) else stream)


def loads(source: DataFrame, corpus: Corpus, shared) -> dict[int, int]:
    """Shards with so much more to score than their share that several tasks make their trie: those of a frequent pair of
    words, since the rows of a frequent word are dealt out by the word before, or of the start of very many texts."""

    often = corpus.first_below(corpus.per_shard)  # only words before that number, and the start, are in so many rows

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, _, _, lengths, stream in words_of(part, shared and shared.value):
                at = np.flatnonzero(stream < often)
                before = np.concatenate([[START], stream])[at]
                before[np.isin(at, np.cumsum(lengths) - lengths)] = START
                n = np.bincount(corpus.shard(before, stream[at]), minlength=corpus.shards)
                n[corpus.shard(np.array([NOTHING]), np.array([START]))] += len(lengths)
                yield pd.DataFrame({"shard": np.flatnonzero(n), "n": n[n > 0]})

    found = source.mapInPandas(count, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    return {r["shard"]: 1 + -(-r["n"] // corpus.per_shard) for r in found.where(F.col("n") > corpus.per_shard).collect()}


def scattered(source: DataFrame, corpus: Corpus, shared) -> DataFrame:
    """What each shard has to know and to score."""

    copies = corpus.copies

    def scatter(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for batch, ids, learn, lengths, stream in words_of(part, shared and shared.value):
                rows = Rows.of(lengths, stream)
                count = corpus.count(rows.w)
                logs = np.log10((count + 1) / (corpus.tokens + corpus.kinds + 1))
                n = len(lengths)
                sums = [np.bincount(rows.doc, x, n) for x in (None, count > 0, logs)]
                about = np.concatenate([learn, *sums]).astype("<f8").tobytes()
                out = [(batch % corpus.shards, 0, TEXTS, batch, ids, zstandard.compress(about, 1))]
                shard = corpus.shard(rows.u, rows.v)
                learned = learn[rows.doc]
                # rows to learn from are counted here only where a shard is made several times, else they come with the others
                v, u, w, times = counted(rows, learned & np.isin(shard, list(copies)))
                known = [(corpus.shard(u, v), u, v, w, times)]
                often = learned & (corpus.spread(rows.v) > 1)
                if often.any():
                    # each part of a word's rows has to know all its pairs
                    pv, _, pw, pn = merged([(rows.v[often], rows.w[often], rows.w[often], np.ones(int(often.sum()), np.int64))])
                    spread = corpus.spread(pv)
                    at = np.repeat(np.arange(len(pv)), spread)
                    nth = np.arange(len(at)) - np.repeat(np.cumsum(spread) - spread, spread)
                    known.append((corpus.bucket(pv[at], nth), np.full(len(at), ANY), pv[at], pw[at], pn[at]))
                to, u, v, w, times = (np.concatenate(x) for x in zip(*known, strict=True))
                for k, at in split(to, corpus.shards):
                    data = squeezed(u[at], v[at], w[at], times[at])
                    out += [(k, salt, PAIRS, batch, None, data) for salt in range(copies.get(k, 1))]
                for k, at in split(shard, corpus.shards):
                    for salt in range(copies.get(k, 1)):
                        own = at[salt :: copies[k]] if k in copies else at
                        if len(own):
                            # a step in texts, and whether the row is learned from here
                            steps = 2 * np.diff(rows.doc[own], prepend=0) + (0 if k in copies else learned[own])
                            out.append((k, salt, QUERIES, batch, None, squeezed(rows.u[own], rows.v[own], rows.w[own], steps)))
                for at in range(0, len(out), 64):
                    yield pd.DataFrame(out[at : at + 64], columns=COLUMNS)

    return source.mapInPandas(scatter, SCATTERED)


SCORED = "batch long, ids array<string>, data binary"


def scored(dealt: DataFrame, corpus: Corpus, model: Model) -> DataFrame:
    """Each task reads its shards one after another: what they know becomes the trie, past which goes what is to be scored.
    What a shard both learns from and scores waits for its trie as it came, compressed."""

    def small(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        return tuple(x.astype(np.uint32) for x in rows)

    def score(trie: Trie, waiting: list[tuple[int, bytes]]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch, data in waiting:
            held.append((batch, *opened(data)))
            size += len(held[-1][1])
            if size >= ROWS:
                yield sums(trie, held)
                held, size = [], 0
        if held:
            yield sums(trie, held)

    def sums(trie: Trie, held: list[tuple]) -> pd.DataFrame:
        u, v, w = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
        logs, out, at = trie.score(u, v, w, corpus.probability(w)), [], 0
        for batch, _, _, _, steps in held:
            docs, first = np.unique((steps >> 1).cumsum(), return_index=True)
            total = np.add.reduceat(logs[at : at + len(steps)], first).astype("<f4")
            out.append((batch, None, b"s" + zstandard.compress(np.diff(docs, prepend=0).astype("<u4").tobytes() + total.tobytes(), 1)))
            at += len(steps)
        return frame(out)

    def trie_of(held: list[tuple[np.ndarray, ...]]) -> Trie:
        held = held or [(np.zeros(0, np.uint32),) * 4]
        return Trie.of(*merged(held), corpus.probability, model.discount).mapped()

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["batch", "ids", "data"])

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, trie, held, size, waiting = None, None, [], 0, []

        for part in parts:
            for shard, salt, kind, batch, ids, data in part[COLUMNS].itertuples(index=False):
                if (shard, salt) != now:
                    if waiting:
                        yield from score(trie_of(held), waiting)
                    now, trie, held, size, waiting = (shard, salt), None, [], 0, []
                if kind == TEXTS:
                    yield frame([(batch, ids, b"t" + data)])
                elif kind == QUERIES and shard in copies:
                    trie = trie or trie_of(held)
                    yield from score(trie, [(batch, data)])
                else:
                    u, v, w, n = opened(data)
                    if kind == QUERIES:
                        waiting.append((batch, data))
                        learned = (n & 1) > 0
                        u, v, w, n = u[learned], v[learned], w[learned], np.ones(int(learned.sum()), np.int64)
                    held.append(small((v, u, w, n)))
                    size += len(v)
                    if size > model.per_shard // 2 and size > 2 * len(held[0][0]):
                        held = [merged(held)]
                        size = len(held[0][0])
        if waiting:
            yield from score(trie_of(held), waiting)

    copies = corpus.copies
    return dealt.mapInPandas(work, SCORED)


RESULT = "id string, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def combined(parts: DataFrame, corpus: Corpus) -> DataFrame:
    """A batch's partial sums, at most one for each of its tokens, as one row for each text."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("data")  # the same sum however parts arrive
        texts = next(i for i, d in enumerate(group["data"]) if d[:1] == b"t")
        ids = group["ids"].iloc[texts]
        n = len(ids)
        learn, tokens, known, base = np.frombuffer(zstandard.decompress(group["data"].iloc[texts][1:]), "<f8").reshape(4, n)
        score = np.zeros(n)
        for data in group["data"]:
            if data[:1] == b"s":
                steps, logs = np.frombuffer(zstandard.decompress(data[1:]), "<u4").reshape(2, -1)
                score[steps.astype(np.int64).cumsum()] += logs.view("<f4")
        return pd.DataFrame({
            "id": ids, "learned": learn > 0, "n_tokens": tokens.astype(np.int64), "n_known": known.astype(np.int64),
            "train_tokens": corpus.tokens, "base_score": base, "score": score,
        })

    return parts.groupBy("batch").applyInPandas(add, RESULT)


def log_probabilities(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", model: Model = Model()) -> DataFrame:
    """``(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score)`` of every whole text, the model being that of the
    texts where ``learn`` is true. ``score`` is the log10 probability of a text's words, A-Z lower-cased, and its end;
    ``base_score`` that of its words without context, each with one count more than it has.

    Three steps. Texts become batches of word numbers; the distinct words of all batches are counted, and numbered by
    falling count, so that a word's count follows from its number. Then each token, with the two before it, goes to a shard
    by the word before it; the rows of a word that fill more than a shard are dealt out by the word before that, and each
    part knows the word's pairs. A shard's task builds its trie from counts and streams what is to be scored past it; a shard
    with more to score than twice its share is built in several tasks. Sums of a text come together by batch.

    Null and empty texts are an end alone. Without a text to learn from every token has the probability of an unknown word.
    Repeated rows are learned from, and scored, as often as they come. Ids pass through, also null and repeated ones. Very long
    texts are numbered whole. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = small_batches(docs).select(F.col(doc_id).cast("string").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), whole_text(text).alias("text"))
    for seed in itertools.count(42):
        stored = cut_lineage(batches(source, model, seed))
        words, clash = numbered_words(stored)
        if not clash:
            break
    steps = count_steps(words)
    counts, sizes = np.array([s[0] for s in steps], np.int64), np.array([s[1] for s in steps], np.int64)
    firsts = WORDS + np.cumsum(sizes) - sizes
    ends, everything = source.agg(F.count(F.when(F.col("learn"), 1)), F.count(F.lit(1))).first()
    tokens, kinds = int((counts * sizes).sum()) + ends, int(sizes[counts > 0].sum()) + (ends > 0)
    corpus = Corpus(counts, firsts, ends, tokens, kinds, max(1, -(-(tokens + everything - ends) // model.per_shard)), model.per_shard)
    shared = None
    if int(sizes.sum()) <= model.max_shared:
        got = words.select("hashes", "others").toArrow()
        hashes, times = (np.frombuffer(b"".join(x.as_py() for x in got[c]), "<i8") for c in ("hashes", "others"))
        number = np.empty(len(hashes), np.int32)
        number[np.lexsort((hashes, -times))] = np.arange(WORDS, WORDS + len(hashes))
        order = np.argsort(hashes)
        shared = spark.sparkContext.broadcast((hashes[order], number[order]))
        ready = stored.select("batch", "ids", "texts", "hashes")
    else:
        every = listed(words, "part", True).withColumn("fewer", -F.col("times"))
        ranked = rank_rows(cut_lineage(every.select("fewer", "hash")), [], ["fewer", "hash"], "number")
        numbers = ranked.select("hash", (F.col("number") + F.lit(WORDS - 1)).alias("number"))
        lists = listed(stored, "batch", False).join(numbers, "hash").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("numbers"))
        lists = lists.select("key", F.col("numbers.number").alias("numbers"))
        ready = cut_lineage(stored.select("batch", "ids", "texts").join(lists, F.col("batch") == F.col("key"), "left").drop("key"))
    corpus = replace(corpus, copies=loads(ready, corpus, shared))
    dealt = scattered(ready, corpus, shared).repartition(F.col("shard"), F.col("salt")).sortWithinPartitions("shard", "salt", "kind", "batch")
    found = combined(scored(dealt, corpus, model), corpus)
    kind = docs.schema[doc_id].dataType
    return found.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", doc_id)
