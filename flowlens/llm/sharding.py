"""Two-pass external shuffle: records scattered into buckets by a seeded hash, each bucket shuffled, shards cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import fresh, row_hash, whole_text

CELLS = 1 << 14
BUCKET_BYTES = 32 << 20


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of the text, none for null, and one for its end."""
    return F.octet_length(whole_text(text)).cast("long") + 1


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform order of ``n`` things. ``Generator.permutation`` is a Fisher-Yates shuffle."""
    return np.random.default_rng([seed, bucket]).permutation(n)


def positions(bucket: Column, start: Column, n: Column, seed: int) -> Column:
    """The global place of each row of a partition that is sorted by bucket. Holds one order of a bucket at a time."""

    @F.pandas_udf("long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        now, order, at = None, np.empty(0, np.int64), 0
        for buckets, starts, sizes in batches:
            b, s, m = (x.to_numpy(np.int64) for x in (buckets, starts, sizes))
            out = np.empty(len(b), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if b[i] != now:
                    now, at = b[i], 0
                    order = fisher_yates(int(m[i]), seed, int(now))
                out[i:j] = s[i:j] + order[at : at + j - i]
                at += j - i
            yield pd.Series(out)

    # what it gives hangs on the order of the rows, so the sort before it must stay
    return place.asNondeterministic()(bucket, start, n)


def shuffle_into_shards(
    docs: DataFrame, shards: int = 16, seed: int = 5, bucket_bytes: int = BUCKET_BYTES, text: str = "text"
) -> DataFrame:
    """``docs`` in shuffled order with ``shard`` and ``slot`` (replaced if there): shard sizes are at most one row apart.

    Pass one deals whole records to buckets of about ``bucket_bytes`` by a seeded hash of id and text (16,384 cells,
    grouped), one exchange. Pass two puts a bucket into a fixed order, draws a Fisher-Yates order of its row numbers and
    sorts the records by it. Only the numbers are held; records sort externally, so a bucket of many equal rows, which no
    hash can part, streams too. The driver holds the row counts of the cells. Each partition is one range of
    the order, which shards cut evenly: slots of a shard are 0 .. n - 1. Reruns give the same places up to equal rows. Null
    ids and texts hash as nulls; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    cell, order, bucket, where = (fresh(docs, x) for x in ("__cell", "__order", "__bucket", "__position"))
    keyed = docs.withColumn(order, F.xxhash64(F.lit(seed), row_hash(text)))
    keyed = keyed.withColumn(cell, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(order)), F.lit(CELLS)).cast("int"))
    cells = keyed.groupBy(cell).agg(F.count(F.lit(1)), F.sum(size_of(text))).collect()
    total = sum(n for _, n, _ in cells)
    buckets = max(1, min(CELLS, -(-sum(x[2] for x in cells) // bucket_bytes)))
    counts = [0] * buckets
    for c, n, _ in cells:
        counts[c * buckets // CELLS] += n
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).tolist()
    at, start, n = (fresh(docs, x) for x in ("__b", "__start", "__n"))
    plan = spark.createDataFrame(list(zip(range(buckets), starts, counts, strict=True)), f"`{at}` int, `{start}` long, `{n}` long")
    dealt = keyed.withColumn(bucket, F.expr(f"cast(`{cell}` * {buckets} div {CELLS} as int)"))
    dealt = dealt.join(F.broadcast(plan), F.col(bucket) == F.col(at))  # at most CELLS rows
    dealt = dealt.repartitionById(buckets, F.col(bucket)).sortWithinPartitions(bucket, order)
    placed = dealt.withColumn(where, positions(F.col(bucket), F.col(start), F.col(n), seed)).sortWithinPartitions(where)
    shard = F.expr(f"cast(`{where}` * {shards} div {max(1, total)} as int)")
    first = F.expr(f"(`{where}` * {shards} div {max(1, total)} * {total} + {shards - 1}) div {shards}")
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], shard.alias("shard"), (F.col(where) - first).alias("slot"))


def write_shards(placed: DataFrame, folder: str) -> None:
    """One folder for each shard, through Spark's committer: a lost task leaves nothing behind."""
    placed.write.partitionBy("shard").parquet(folder)
