"""Cross-tokenizer alignment: two token sequences of the same bytes cut into groups where tokens of both end."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import fresh, whole_text
from flowlens.llm.token_output import PATTERN
from flowlens.plans.small import cut_lineage

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct id pairs whose counts are handed to every task as arrays of 16 bytes each; more are joined.
MAX_SHARED_PAIRS = 1 << 22
HELD = 1 << 22  # pairs that a task holds before it sums them up
SINGLY = 8  # most runs of equal ends are short: as many are compared one by one

#: Characters whose class is the same in every version of Unicode that the libraries may know. Other texts go to the
#: slower of two byte-pair coders, whose file this is.
STABLE = re.compile(
    "[\x00-ɏΑ-ΡΣ-ώЀ-ԯ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]*"
)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Entries:
    """The bytes of all ids of a vocabulary in one array, and their numbers in print: with a comma, and with the mark that ends a
    group's side."""

    def __init__(self, entries: list[bytes], mark: str):
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        self.sizes = np.array(list(map(len, entries)), np.int64)
        self.starts = self.sizes.cumsum() - self.sizes
        self.printed = np.array([f"{i}{after}".encode() for after in (",", mark) for i in range(len(entries))])

    def joined(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ``ids`` and the end of each."""
        sizes = self.sizes[ids]
        ends = sizes.cumsum()
        places = np.repeat(self.starts[ids] - ends + sizes, sizes)
        places += np.arange(len(places))
        return self.blob[places].tobytes(), ends

    def said(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.printed[ids + last * len(self.sizes)]


class ByteLevel:
    """Ids of a byte-level vocabulary file, and the bytes of each; special tokens in a text are plain text."""

    def __init__(self, file: bytes):
        self.slow = tokenizers.Tokenizer.from_str(file.decode())
        self.slow.encode_special_tokens = True
        said, alphabet = json.loads(file), byte_alphabet()
        added = {x["content"] for x in said["added_tokens"]}
        ranks = {bytes(map(alphabet.__getitem__, k)): v for k, v in said["model"]["vocab"].items() if k not in added}
        self.quick = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes[v] = k
        self.entries = Entries(self.bytes, "|")

    def __call__(self, text: str) -> list[int]:
        text = " " + text
        if STABLE.fullmatch(text):
            return self.quick.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a piece model, which puts a space before the text itself, and the bytes of each."""

    def __init__(self, file: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            coded = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.bytes.append(bytes([int(coded[1], 16)]) if coded else piece.replace("▁", " ").encode())
        self.entries = Entries(self.bytes, ";")

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text)


@dataclass(frozen=True)
class Vocabularies:
    """Paths of the two files; the driver reads them and ships them with the task."""

    a: str = BYTE_LEVEL
    b: str = PIECES

    def files(self) -> tuple[bytes, bytes]:
        with open(self.a, "rb") as a, open(self.b, "rb") as b:
            return a.read(), b.read()


def common_run(x: list[int], y: list[int], i: int, j: int) -> int:
    """How many entries from ``x[i]`` and ``y[j]`` on are equal, one by one: the first few singly, then stretches of doubling
    length, then halving."""
    limit, n, width = min(len(x) - i, len(y) - j), 0, SINGLY
    few = min(limit, SINGLY)
    while n < few and x[i + n] == y[j + n]:
        n += 1
    if n < few:
        return n
    while n < limit:
        width = min(width, limit - n)
        if x[i + n : i + n + width] != y[j + n : j + n + width]:
            break
        n += width
        width *= 2
    else:
        return n
    width //= 2  # the stretch of ``width`` differs somewhere
    while width:
        if x[i + n : i + n + width] == y[j + n : j + n + width]:
            n += width
        width //= 2
    return n


def stretches(ends_a: list[int], ends_b: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stretches ``(i, j, n)`` of one-to-one groups of two rising lists with the same last entry; what lies between two of them,
    or after the last, is one group. An empty stretch stands between neighbours of that kind, and where one ends the lists.

    While tokens match one to one, the shift between the lists stays and whole stretches are compared at once. Where the
    ends part, the side that is behind moves on until both meet; from there the shift is another.
    """
    i = j = 0
    while True:
        n = common_run(ends_a, ends_b, i, j)
        yield i, j, n
        i, j = i + n, j + n
        if i == len(ends_a):
            return
        x, y = ends_a[i], ends_b[j]
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        i, j = i + 1, j + 1


def align(ends_a: list[int], ends_b: list[int]) -> Iterator[tuple[int, int, int, int, list[tuple[int, int]]]]:
    """Groups ``(i, i_end, j, j_end, met)`` of two rising lists with the same last entry, by ``stretches``. A stretch of
    one-to-one groups comes as one entry, of equal length on both sides and with nothing in ``met``; of any other group
    ``met`` has the places whose ranges overlap."""
    i = j = 0
    for p, q, n in stretches(ends_a, ends_b):
        if i < p:
            met = [(i, j)]
            while met[-1] != (p - 1, q - 1):
                x, y = met[-1]
                met.append((x + 1, y) if ends_a[x] < ends_b[y] else (x, y + 1))
            yield i, p, j, q, met
        if n:
            yield p, p + n, q, q + n, []
        i, j = p + n, q + n


@dataclass
class Aligned:
    """Of one text: numbers of tokens and groups, the groups as text, and its distinct id pairs with how many links each has."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: str = ""
    a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def aligned(text: str, coder_a: ByteLevel, coder_b: Pieces) -> Aligned:
    if not text:
        return Aligned()
    whole = b" " + text.encode("utf-8", "replace")
    a, b = (np.array(coder(text), np.int64) for coder in (coder_a, coder_b))
    (bytes_a, ends_a), (bytes_b, ends_b) = coder_a.entries.joined(a), coder_b.entries.joined(b)
    if bytes_a != whole or bytes_b != whole:
        return Aligned()
    last_a, last_b = last_of_groups(ends_a, ends_b)
    # in print, a token comes after all groups before its own, and one of B after its own group's of A
    before = np.concatenate([[0], last_b + 1])
    ends_group = [np.zeros(len(x), bool) for x in (a, b)]
    ends_group[0][last_a] = ends_group[1][last_b] = True
    group_a, group_b = (x.cumsum() - x for x in ends_group)
    said_a, said_b = coder_a.entries.said(a, ends_group[0]), coder_b.entries.said(b, ends_group[1])
    said = np.empty(len(a) + len(b), np.result_type(said_a, said_b))
    said[np.arange(len(a)) + before[group_a]] = said_a
    said[np.arange(len(b)) + last_a[group_b] + 1] = said_b
    said = said.view(np.uint8)
    groups = said[said != 0].tobytes().decode("ascii")[:-1]
    # two tokens overlap up to the nearer of their ends: each end of A, and each of B inside a token of A, is one link's
    inside = np.flatnonzero(~ends_group[1])
    left = np.concatenate([a, a[np.searchsorted(ends_a, ends_b[inside])]])
    right = np.concatenate([b[np.searchsorted(ends_b, ends_a)], b[inside]])
    codes, links = np.unique(left << 32 | right, return_counts=True)
    return Aligned(len(a), len(b), len(last_a), groups, codes >> 32, codes & 0xFFFFFFFF, links)


def last_of_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the last tokens of all groups on both sides."""
    found = np.fromiter(chain.from_iterable(stretches(ends_a.tolist(), ends_b.tolist())), np.int64).reshape(-1, 3)
    i, j, n = found.T
    # a stretch stands for its own groups and the one that ends before it
    first = (n + 1).cumsum() - (n + 1)
    along = np.arange(int((n + 1).sum()))
    last = [np.repeat(x - 1 - first, n + 1) + along for x in (i, j)]
    return last[0][1:], last[1][1:]


def packed(x: Aligned) -> bytes:
    """Id pairs and links for the way to the next pass: rising ids of one side as steps."""
    steps = np.diff(x.a, prepend=0)
    planes = np.concatenate([steps, x.b, x.links]).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``a << 32 | b`` in rising order and their links."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    steps, b, links = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64).reshape(3, -1)
    return steps.cumsum() << 32 | b, links


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def texts_aligned(docs: DataFrame, vocabularies: Vocabularies, text: str, say_groups: bool) -> DataFrame:
    files, kept = vocabularies.files(), [c for c in docs.columns if c != text]
    result = ALIGNED + (", groups string" if say_groups else "")
    names = [x.split()[0] for x in result.split(", ")] + ["pairs"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder_a, coder_b = ByteLevel(files[0]), Pieces(files[1])
        for batch in batches:
            rows = []
            for x in (aligned(t, coder_a, coder_b) for t in batch["text"]):
                sha = hashlib.sha256(x.groups.encode()).hexdigest() if x.n_a else ""
                rows.append((x.n_a, x.n_b, x.n_groups, int(x.links.sum()), sha, *([x.groups] if say_groups else []), packed(x)))
            made = pd.DataFrame(rows, columns=names)
            yield pd.concat([batch[kept], made.set_index(batch.index)], axis=1)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]
    return docs.select(*kept, whole_text(text).alias("text")).mapInPandas(work, ", ".join([*kinds, result, "pairs binary"]))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.zeros(len(codes), np.int64)
    np.add.at(total, at, np.concatenate([p[1] for p in parts]))
    return codes, total


def pair_counts(stored: DataFrame) -> DataFrame:
    """``(a, b, n)``: links of each id pair over all texts, summed up in the tasks first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            for data in batch["pairs"]:
                parts.append(unpacked(data))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [summed(parts)]
                    if (held := len(parts[0][0])) > HELD // 2:
                        yield table_of(parts.pop())
                        held = 0
        if parts:
            yield table_of(summed(parts))

    def table_of(x: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"a": x[0] >> 32, "b": x[0] & 0xFFFFFFFF, "n": x[1]})

    found = stored.select("pairs").mapInPandas(count, "a long, b long, n long")
    return cut_lineage(found.groupBy("a", "b").agg(F.sum("n").alias("n")))


def looked_up(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """``n_best`` and ``count_sum`` from all counts as sorted arrays, which every Python worker holds once."""
    spark = stored.sparkSession
    got = counts.toArrow()
    a, b, n = (got[c].to_numpy() for c in ("a", "b", "n"))
    order = np.argsort(codes := a << 32 | b)
    best = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
    np.maximum.at(best, b, n)
    shared = spark.sparkContext.broadcast((codes[order], n[order], best))
    kept = [c for c in stored.columns if c != "pairs"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, count, best = shared.value
        for batch in batches:
            rows = []
            for data in batch["pairs"]:
                own, links = unpacked(data)
                n = count[np.searchsorted(codes, own)]
                rows.append((int(links[n == best[own & 0xFFFFFFFF]].sum()), int((links * n).sum())))
            yield pd.concat([batch[kept], pd.DataFrame(rows, columns=["n_best", "count_sum"]).set_index(batch.index)], axis=1)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name != "pairs"]
    return stored.mapInPandas(look, ", ".join([*kinds, "n_best long, count_sum long"]))


def joined(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """The same through joins, for any number of distinct pairs."""
    no = fresh(stored, "__no")
    stored = stored.withColumn(no, F.monotonically_increasing_id())

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, data in zip(batch["no"], batch["pairs"], strict=True):
                codes, links = unpacked(data)
                yield pd.DataFrame({"no": row, "a": codes >> 32, "b": codes & 0xFFFFFFFF, "links": links})

    best = counts.groupBy("b").agg(F.max("n").alias("best"))
    known = counts.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("best")).alias("is_best"))
    pairs = stored.select(F.col(no).alias("no"), "pairs").mapInPandas(listed, "no long, a long, b long, links long")
    sums = pairs.join(known, ["a", "b"]).groupBy("no").agg(
        F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")
    )
    found = stored.join(sums.withColumnRenamed("no", "__sum_of"), F.col(no) == F.col("__sum_of"), "left")
    filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return found.select(*[c for c in stored.columns if c not in (no, "pairs")], *filled)


def align_tokenizers(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabularies: Vocabularies = Vocabularies(),
    say_groups: bool = False,
    max_shared: int = MAX_SHARED_PAIRS,
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)`` of every whole text, ``groups`` as text too
    if wanted.

    Tokens of both vocabularies that end at the same byte end a group. A link is a pair of tokens whose bytes overlap; an id
    pair counts its links over all texts; ``n_best`` are links whose pair no other pair of the same second id outnumbers,
    ``count_sum`` adds the counts up over links. Counts are summed in each task, then by pair; up to ``max_shared`` pairs
    are handed to the tasks, more are joined with the texts' pairs.

    Null and empty texts, and those that a vocabulary can't give back byte by byte, have no tokens: zeros, no groups.
    Repeated rows count as often as they come. Other columns are not read. An empty table gives an empty one.
    """
    stored = cut_lineage(texts_aligned(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), vocabularies, "text", say_groups))
    counts = pair_counts(stored)
    find: Callable[[DataFrame, DataFrame], DataFrame] = looked_up if counts.count() <= max_shared else joined
    return find(stored, counts)
