"""SimHash near-duplicates through covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import fresh, row_hash, whole_text
from flowlens.llm.components import apart, components
from flowlens.plans.small import cut_lineage

BITS = 64
RADIUS = 2
SHINGLE = 3
BLOCK = 1 << 15  # shingles whose bits are counted at once


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int = RADIUS) -> list[int]:
    """``2 ** (radius + 1) - 1`` masks such that bits at any ``radius`` places are all 0 in one mask at least.

    Place i has the nonzero vector ``i mod tables + 1`` over two elements; mask v holds the places whose vector has an odd
    overlap with v. ``radius`` vectors of ``radius + 1`` elements always have a common v of even overlap, and its mask
    leaves out all of them. (Pagh, CoveringLSH, 2016.)
    """
    tables = 2 ** (radius + 1) - 1
    return [
        sum(1 << i for i in range(BITS) if ((i % tables + 1) & v).bit_count() % 2)
        for v in range(1, tables + 1)
    ]


def fingerprint(text: str) -> int:
    """64 bits, each the majority over the XXH64 of all word shingles; see ``fingerprints``."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only space and \\x09-\\x0D split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    from_, to = starts[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist()
    for at in range(0, n, BLOCK):
        hashes = np.array(
            [digest(joined[a:b], 42) for a, b in zip(from_[at : at + BLOCK], to[at : at + BLOCK], strict=True)], "<u8"
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(text: Column) -> Column:
    """A signed long with the bits of the fingerprint. A text without a word, or null, has 0."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return simhash(whole_text(text))


def links(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints ``fp`` at most two bits apart, without their pairs.

    Each table keeps the bits of its mask. Fingerprints alone in all their buckets are done. One that shares a bucket of
    table t may differ from the others there in the bits that t leaves out: it is listed under itself and under each flip
    of one such bit. Two fingerprints two bits apart meet under the one between them, those one bit apart under either, and
    what meets is never further apart. At most 65 meet in one place, whatever the size of a bucket, and each is
    linked to the lowest.
    """
    masks = [signed(m) for m in covering_masks()]
    tables = prints.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
        ).alias("x"),
    ).select("fp", "x.t", "x.key", F.xxhash64("x.t", "x.key").alias("slot"))
    crowded = tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = crowded.select(F.xxhash64("t", "key").alias("slot"))
    left_out = F.element_at(F.array(*[F.lit(signed(~m & (1 << BITS) - 1)) for m in covering_masks()]), F.col("t") + 1)
    near = tables.join(crowded, "slot", "left_semi").groupBy("fp").agg(F.bit_or(left_out).alias("free"))
    flips = F.filter(
        F.array(*[F.lit(signed(1 << i)) for i in range(BITS)]), lambda bit: F.col("free").bitwiseAND(bit) != F.lit(0)
    )
    middle = near.select("fp", F.explode(F.concat(F.array("fp"), F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit)))).alias("m"))
    met = middle.groupBy("m").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, fp, row, component_id, keeper)`` of every row: fingerprints connected by steps of two bits or less.

    ``component_id`` is the smallest id reachable, the row's own included (null where no row of the component has an
    id). ``row`` is a hash of id and text, ``keeper`` that of the component's row with the smallest id. Null and empty texts
    have fingerprint 0 and are linked as any other. Copies collapse to one fingerprint before any search, so that a group
    of any size costs one entry. Repeated rows get repeated results; other columns are not read.
    """
    rows = cut_lineage(docs.select("doc_id", fingerprints(F.col(text)).alias("fp"), row_hash(text).alias("row")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    prints = cut_lineage(rows.groupBy("fp").agg(first.alias("first")))
    return with_keepers(rows, prints, components(links(prints)))


def with_keepers(rows: DataFrame, prints: DataFrame, named: DataFrame) -> DataFrame:
    """``rows(doc_id, fp, row)`` with the smallest id of their component and its row, by ``prints(fp, first)`` and the
    ``named`` nodes among them."""
    named = prints.join(named, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    lowest = lowest.select(apart("component").alias("c"), "lowest")
    classes = named.join(lowest, F.col("component") == F.col("c")).select(apart("fp").alias("f"), "lowest")
    return rows.join(classes, F.col("fp") == F.col("f")).select(
        "doc_id", "fp", "row", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.row").alias("keeper")
    )


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id; all columns pass through.

    A component without ids keeps one row. If the row that stays is repeated, one of its equals stays.
    """
    return keepers_only(docs, near_duplicates(docs, text), text)


def keepers_only(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """Those of ``docs`` that ``found`` names as keepers."""
    kept = found.where("row = keeper").groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    kept = cut_lineage(kept)
    key, stays = fresh(docs, "__row"), fresh(docs, "__kept")
    found = docs.withColumn(key, row_hash(text)).join(
        kept.select(apart("row").alias(stays)), F.col(key) == F.col(stays), "left_semi"
    )
    if not kept.where("copies > 1").isEmpty():
        found = found.dropDuplicates([key])
    return found.drop(key)
