"""Personal data by bootstrapped contextual extraction."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import row_hash, whole_text
from flowlens.llm.components import apart
from flowlens.plans.small import cut_lineage, small_enough

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run is matched from its first digit only, as the leftmost match is
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
EDGES = ".,;:!?\"'()[]{}<>|*#$%&"


@dataclass(frozen=True)
class Bootstrap:
    """``rounds`` at most; a pattern counts with ``support`` distinct known instances and a share of ``precision`` of what
    fills it; an instance is accepted with ``patterns`` distinct patterns and a score of ``accept``."""

    rounds: int = 4
    support: float = 3.0
    precision: float = 0.8
    patterns: int = 2
    accept: float = 0.95
    shortest: int = 5
    longest: int = 64


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern; each '@' is tried once, from the start of the run before it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m.group().split("."))):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a slot: two words before, and the word on either side, with digits as 0."""
    before = text[max(0, start - 80) : start].lower().split()[-2:]
    after = text[end : end + 40].lower().split()[:1]
    left = " ".join(["^", "^", *before][-2:])
    right = (after or ["$"])[0]
    found = [f"{left} _", f"{left.rsplit(' ', 1)[-1]} _ {right}"]
    return [re.sub("[0-9]", "0", x) for x in found]


def candidates(text: str, spans: list[tuple[str, int, int]], rule: Bootstrap) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or '@' that no base span touches, without the marks at their ends."""
    taken = sorted((a, b) for _, a, b in spans)
    done = i = 0
    for m in SIGN.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = TOKEN.match(text, start).end()
        end = done
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        if not rule.shortest <= end - start <= rule.longest:
            continue
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if not any(a < end and b > start for a, b in taken[i : i + 8]):
            yield start, end


FOUND = (
    "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "slots array<struct<kind:string,start:int,end:int,instance:string,patterns:array<string>>>"
)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def scan(docs: DataFrame, rule: Bootstrap, text: str) -> DataFrame:
    """For each row its base spans, and the slots of base entities (with a kind) and of candidates (without)."""
    source = docs.select(row_hash(text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                spans = base_spans(text)
                slots = [(k, a, b) for k, a, b in spans] + [(None, a, b) for a, b in candidates(text, spans, rule)]
                said = joined(spans)
                counts = [sum(s[0] == k for s in spans) for k in KINDS]
                rows.append(
                    (
                        row, None if pd.isna(doc_id) else int(doc_id), *counts, hashlib.sha256(said.encode()).hexdigest(), said,
                        [{"kind": k, "start": a, "end": b, "instance": text[a:b].lower(), "patterns": contexts(text, a, b)}
                         for k, a, b in slots],
                    )
                )
            yield pd.DataFrame(rows, columns=["row", "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "slots"])

    return source.mapInPandas(extract, FOUND)


def strong_patterns(edges: DataFrame, sizes: DataFrame, known: DataFrame, rule: Bootstrap) -> DataFrame:
    """``(pattern, kind, confidence)``: the mean score of a pattern's distinct instances, if it has the support."""
    scored = edges.join(known.select(apart("instance_key").alias("k"), "kind", "score"), F.col("instance_key") == F.col("k"))
    sums = scored.groupBy("pattern_key", "kind").agg(F.sum("score").alias("found"))
    sums = sums.where(F.col("found") >= rule.support)
    return (
        sums.join(sizes.select(apart("pattern_key").alias("p"), "n", "pattern"), F.col("pattern_key") == F.col("p"))
        .withColumn("confidence", F.col("found") / F.col("n"))
        .where(F.col("confidence") >= rule.precision)
        .select("pattern_key", "pattern", "kind", "confidence")
    )


def discovered(slots: DataFrame, rule: Bootstrap) -> tuple[DataFrame, DataFrame]:
    """Accepted instances ``(instance_key, kind, score)`` that no base pattern matches, and the patterns that found them.

    A bipartite graph of patterns and distinct instances (copies of a document add nothing). Base entities score 1 in
    their kind. Each round scores patterns by their instances and then instances by their patterns, 1 - product of (1 -
    confidence), until nothing new is accepted.
    """
    edges = cut_lineage(
        slots.select("instance_key", F.explode("patterns").alias("pattern"), "kind")
        .withColumn("pattern_key", F.xxhash64("pattern"))
        .groupBy("pattern_key", "instance_key")
        .agg(F.first("pattern").alias("pattern"), F.max("kind").alias("kind"))
    )
    sizes = edges.groupBy("pattern_key").agg(F.count(F.lit(1)).alias("n"), F.first("pattern").alias("pattern"))
    # a pattern with fewer instances than the support never counts
    sizes = cut_lineage(sizes.where(F.col("n") >= rule.support))
    graph = cut_lineage(
        edges.select("pattern_key", "instance_key", "kind").join(
            sizes.select(apart("pattern_key").alias("p")), F.col("pattern_key") == F.col("p"), "left_semi"
        )
    )
    seeds = cut_lineage(
        edges.where(F.col("kind").isNotNull()).select("instance_key", "kind").distinct().withColumn("score", F.lit(1.0))
    )
    spare = graph.where(F.col("kind").isNull()).select("pattern_key", "instance_key")
    links = graph.select("pattern_key", "instance_key")
    known, accepted, strong, before = seeds, None, None, 0
    for _ in range(rule.rounds):
        strong = cut_lineage(strong_patterns(links, sizes, known, rule))
        if strong.isEmpty():
            break
        by_pattern = small_enough(strong).select(apart("pattern_key").alias("p"), "kind", "confidence")
        votes = spare.join(by_pattern, F.col("pattern_key") == F.col("p")).groupBy("instance_key", "kind").agg(
            F.count(F.lit(1)).alias("patterns"),
            (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))).alias("score"),
        )
        best = votes.where((F.col("patterns") >= rule.patterns) & (F.col("score") >= rule.accept)).groupBy("instance_key").agg(
            F.max(F.struct("score", "kind")).alias("best")
        )
        accepted = cut_lineage(best.select("instance_key", F.col("best.kind").alias("kind"), F.col("best.score").alias("score")))
        now = accepted.count()
        if now == before:
            break
        known, before = seeds.union(accepted), now
    empty = seeds.where(F.lit(False))
    return (empty if accepted is None else accepted), strong


def find(docs: DataFrame, rule: Bootstrap = Bootstrap(), text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: counts of the base kinds, ``base_sha256``, all ``spans`` and ``n_found``, those that the
    method adds.

    Base spans are the contract's patterns, leftmost and without overlap for each kind. Added spans are tokens with a digit
    or '@' that only the context tells: they fill at least two patterns that hardly hold anything but one kind. Spans
    are ``kind:start:end`` in code points, by kind and start. Null and empty texts have no span. Repeated rows get repeated
    results; an empty table gives an empty one; other columns are not read.
    """
    scanned = cut_lineage(scan(docs, rule, text))
    slots = scanned.where(F.size("slots") > 0).select("row", F.explode("slots").alias("s")).select(
        "row", "s.*", F.xxhash64("s.instance").alias("instance_key")
    )
    accepted, _ = discovered(slots, rule)
    new = slots.where(F.col("kind").isNull()).drop("kind")
    new = new.join(accepted.select(apart("instance_key").alias("k"), "kind"), F.col("instance_key") == F.col("k"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    added = new.distinct().groupBy("row").agg(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind")).alias("added"))
    rows = scanned.join(added.select(apart("row").alias("r"), "added"), F.col("row") == F.col("r"), "left")
    return rows.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        "base_sha256",
        all_spans().alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_found"),
    )


def all_spans() -> Column:
    """The base spans and the added ones, by kind and start."""
    parts = F.filter(F.split("base", ","), lambda x: x != "")
    ranks = F.array(*map(F.lit, KINDS))

    def parsed(x: Column) -> Column:
        cells = F.split(x, ":")
        return F.struct(
            F.array_position(ranks, cells[0]).alias("rank"), cells[1].cast("int").alias("start"), cells[2].cast("int").alias("end"), cells[0].alias("kind")
        )

    merged = F.array_sort(F.concat(F.transform(parts, parsed), F.col("added")))
    said = F.array_join(F.transform(merged, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return F.when(F.col("added").isNull(), F.col("base")).otherwise(said)
