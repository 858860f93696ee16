"""Hard-negative mining: packed (anchor, falling score, id) keys, a secondary sort, and windows that positives open."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.plans.small import cut_lineage

#: Rows and anchors that are scored against each other at once.
ROWS, ANCHORS, TILE = 1 << 13, 1 << 10, 1 << 7
EXACT = 1 << 53  # whole numbers below are exact as doubles
LONG = (1 << 63) - 1
POSITIVE, NEGATIVE = 0, 1

#: One sort key of 25 bytes, whose order as bytes is: anchor, falling score, positives before negatives, id.
KEY = np.dtype([("anchor", ">u8"), ("fall", ">u8"), ("kind", "u1"), ("id", ">u8")])
_FLIP = np.uint64(1 << 63)


@dataclass(frozen=True)
class Mining:
    """``positives`` of each anchor, ``negatives`` of each of those, whose score is between ``low`` and ``high`` percent of
    the positive's. Components count as whole numbers, ``floor(scale * x)``."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256


def rising(x: np.ndarray) -> np.ndarray:
    """Signed longs as unsigned ones of the same order."""
    return np.asarray(x, np.int64).view(np.uint64) ^ _FLIP


def signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) ^ _FLIP).view(np.int64)


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    keys = np.empty(len(anchor), KEY)
    keys["anchor"], keys["fall"], keys["kind"], keys["id"] = rising(anchor), ~rising(score), kind, rising(ids)
    data, n = keys.tobytes(), KEY.itemsize
    return [data[i : i + n] for i in range(0, len(data), n)]


def unpacked(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    got = np.frombuffer(b"".join(map(bytes, keys)), KEY)
    return signed(got["anchor"]), signed(~got["fall"].astype(np.uint64)), got["kind"], signed(got["id"])


def matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = [len(v) for v in vectors]
    out = np.zeros((len(sizes), max(sizes, default=0)))
    for row, v, n in zip(out, vectors, sizes, strict=True):
        row[:n] = v
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole inner products as longs; a component that one side lacks is zero, what is beyond a long becomes its end."""
    d = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :d], rows[:, :d]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, d)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = np.zeros((len(a), len(b)), object) if not d else whole(a) @ whole(b).T
    return np.clip(out, -LONG - 1, LONG).astype(np.int64)


def first(found: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, row) of the ``k`` highest ``found`` of each anchor where ``ok``; rows come by id, ties go to the first."""
    n = found.shape[1]
    if n > k:
        cut = np.partition(np.where(ok, found, -LONG - 1), n - k, axis=1)[:, n - k, None]
        over = ok & (found > cut)
        level = ok & (found == cut)
        room = k - over.sum(axis=1, keepdims=True)
        ok = over | (level & (np.cumsum(level, axis=1) <= room))
    return ok.nonzero()


BLOCK = "n long, no binary, id binary, label binary, vector binary, windows binary"


def blocks(df: DataFrame, size: int, key: str, key_type: str = "int") -> DataFrame:
    """Rows of ``(no, id, label, vector, windows)`` packed into blocks of one ``key`` each, by id inside."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, part in batch.groupby(key):
                part = part.sort_values(["id", "no"])
                for at in range(0, len(part), size):
                    x = part.iloc[at : at + size]
                    row = [len(x), *(x[c].to_numpy(np.int64).tobytes() for c in ("no", "id", "label"))]
                    row += [matrix(x["vector"]).tobytes(), tops(x["windows"]).tobytes(), k]
                    yield pd.DataFrame([row], columns=["n", "no", "id", "label", "vector", "windows", key])

    return df.mapInPandas(pack, f"{BLOCK}, {key} {key_type}")


def tops(windows: pd.Series) -> np.ndarray:
    """Each row's scores, the first one repeated to the same number for all."""
    lists = [[int(s) for s in w] for w in windows]
    most = max(map(len, lists), default=0)
    return np.array([w + w[:1] * (most - len(w)) for w in lists], np.int64).reshape(len(lists), most)


@dataclass
class Block:
    no: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    windows: np.ndarray

    @classmethod
    def of(cls, row: dict, prefix: str) -> Block:
        n = row[f"{prefix}n"]
        no, ids, label = (np.frombuffer(row[f"{prefix}{c}"], np.int64) for c in ("no", "id", "label"))
        vector, windows = np.frombuffer(row[f"{prefix}vector"]), np.frombuffer(row[f"{prefix}windows"], np.int64)
        return cls(no, ids, label, vector.reshape(n, -1), windows.reshape(n, -1))


def met(anchors: DataFrame, rows: DataFrame, groups: int) -> DataFrame:
    """Every block of anchors beside every block of rows, on a grid: a block of rows goes to each of the anchors' ``groups``,
    a block of anchors to each band of rows, so that no side has to fit into one place."""
    bands = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups)
    left = rows.withColumn("band", F.pmod("part", F.lit(bands))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = blocks(anchors, ANCHORS, "g").withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    right = right.select("g", "band", *[F.col(c).alias(f"a_{c}") for c in right.columns if c not in ("g", "band")])
    return left.join(right, ["g", "band"]).drop("g", "band")


def tiles(pairs: Iterator[pd.DataFrame]) -> Iterator[tuple[Block, Block, slice, np.ndarray]]:
    for batch in pairs:
        for row in batch.to_dict("records"):
            rows, anchors = Block.of(row, ""), Block.of(row, "a_")
            for at in range(0, len(anchors.no), TILE):
                part = slice(at, at + TILE)
                yield rows, anchors, part, scores(anchors.vector[part], rows.vector)


CANDIDATE = "anchor long, score long, key binary"


def candidates(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"anchor": anchor, "score": score, "key": packed(anchor, score, kind, ids)})


def by_key(found: DataFrame) -> DataFrame:
    """The secondary sort: anchors are dealt out, each task gets its keys in order and reads them as a stream."""
    return found.repartition("anchor").sortWithinPartitions("key")


def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, int, int]]:
    for batch in batches:
        yield from zip(*(x.tolist() for x in unpacked(batch["key"].tolist())), strict=True)


def positives_of(anchors: DataFrame, rows: DataFrame, groups: int, mining: Mining) -> DataFrame:
    """``(anchor, score, key)`` of each anchor's first rows of its label; blocks send no more than that many."""

    def score(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, anchors, part, found in tiles(pairs):
            same = (anchors.label[part, None] == rows.label) & (anchors.no[part, None] != rows.no)
            a, r = first(found, same, mining.positives)
            yield candidates(anchors.no[part][a], found[a, r], POSITIVE, rows.id[r])

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken, out = None, 0, []
        for anchor, score, _, other in streamed(batches):
            now, taken = anchor, taken + 1 if anchor == now else 1
            if taken <= mining.positives:
                out.append((anchor, score, other))
        got = np.array(out, np.int64).reshape(-1, 3)
        yield candidates(got[:, 0], got[:, 1], POSITIVE, got[:, 2])

    return by_key(met(anchors, rows, groups).mapInPandas(score, CANDIDATE)).mapInPandas(keep, CANDIDATE)


def negatives_of(anchors: DataFrame, rows: DataFrame, groups: int, mining: Mining) -> DataFrame:
    """``(anchor, score, key)`` of rows of another label that are a block's first in a window of their anchor's ``windows``."""

    def score(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, anchors, part, found in tiles(pairs):
            other = anchors.label[part, None] != rows.label
            wanted = np.zeros(found.shape, bool)
            for top in anchors.windows[part].T:
                fits = other & between(found, top[:, None], mining)
                wanted[first(found, fits, mining.negatives)] = True
            a, r = wanted.nonzero()
            yield candidates(anchors.no[part][a], found[a, r], NEGATIVE, rows.id[r])

    return met(anchors, rows, groups).mapInPandas(score, CANDIDATE)


def between(score: np.ndarray, top: np.ndarray, mining: Mining) -> np.ndarray:
    most = max(np.abs(x.astype(float)).max(initial=0) for x in (score, top))
    if most * 100 >= LONG / 2:
        score, top = score.astype(object), top.astype(object)
    return ((mining.low * top <= 100 * score) & (100 * score <= mining.high * top)).astype(bool)


MINED = "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def windows(found: DataFrame, mining: Mining) -> DataFrame:
    """Reads each anchor's keys from the highest score on: a positive opens a window, a negative goes to all open windows
    that it fits, and a window that is full or left behind is closed. Only open windows are held."""

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, opened, out = None, [], []
        for anchor, score, kind, other in streamed(batches):
            if anchor != now:
                now, opened = anchor, []
            if kind == POSITIVE:
                opened.append([other, score, 0])
                continue
            for window in opened:
                positive, top, taken = window
                if mining.low * top <= 100 * score <= mining.high * top:
                    window[2] = taken + 1
                    out.append((anchor, positive, taken + 1, other, top, score))
            opened = [w for w in opened if w[2] < mining.negatives and mining.low * w[1] <= 100 * score]
            if len(out) >= 1 << 16:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in MINED.split(", ")])
                out = []
        yield pd.DataFrame(out, columns=[x.split()[0] for x in MINED.split(", ")])

    return by_key(found).mapInPandas(mine, MINED)


def usable(vector: Column) -> Column:
    """The vector is there and so are all components, as finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


def mine(vectors: DataFrame, anchors: Column, mining: Mining = Mining()) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``vectors(vec_id, label, embedding)``.

    A score is the inner product of whole numbers, ``floor(scale * x)``; higher ones come first, ties by smaller id. Each
    row of ``anchors`` has its first rows of the same label as positives, and each of those its first rows of other labels
    within the window of its score. Scores are made in blocks: every block of rows meets every block of anchors once for
    the positives and once, when those are known, for the negatives, and sends no more candidates of an anchor than can be
    among its first. So what is sorted of an anchor grows with the number of blocks, not with that of rows.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors may differ in length:
    what one lacks counts as zero. Equal rows are rows of their own, also beside an anchor that they equal; ids may repeat.
    A score beyond a long counts as the nearest long. With ``high`` over 100 negatives above the positive are not seen.
    Other columns are not read. An empty table, and anchors without a positive or a negative, give no rows.
    """
    if mining.high > 100:
        raise ValueError("negatives above the positive's score come before its window")
    vector = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * F.lit(float(mining.scale))).cast("double"))
    taken = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    taken = taken.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vector.alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    # stored before it is numbered: a task that runs again gives the same numbers
    rows = cut_lineage(taken).withColumn("no", F.monotonically_increasing_id())
    chosen = rows.where("is_anchor").drop("is_anchor")
    groups = max(1, -(-chosen.count() // ANCHORS))
    dealt = F.pmod(F.hash("no"), F.lit(groups)).alias("g")
    none = F.array().cast("array<long>").alias("windows")
    blocked = cut_lineage(blocks(rows.select("no", "id", "label", "vector", none, F.spark_partition_id().alias("part")), ROWS, "part"))
    anchor = chosen.repartition(groups, "no").select("no", "id", "label", "vector", none, dealt)
    best = cut_lineage(positives_of(anchor, blocked, groups, mining))
    tops = best.groupBy("anchor").agg(F.collect_list("score").alias("windows"))
    open_ = chosen.join(tops, F.col("no") == F.col("anchor")).repartition(groups, "no")
    found = negatives_of(open_.select("no", "id", "label", "vector", "windows", dealt), blocked, groups, mining)
    mined = windows(best.unionByName(found), mining)
    names = chosen.select(F.col("no").alias("anchor"), F.col("id").alias("anchor_id"))
    return mined.join(names, "anchor").select("anchor_id", *[c for c in mined.columns if c != "anchor"])
