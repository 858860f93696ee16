"""Writing tables, JSON reports and keyed replay subsets."""

from __future__ import annotations

import hashlib
import json
import math
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, path: str, *, columns: list[str] | None = None, fmt: str = "parquet",
                partition_by: tuple[str, ...] = ()) -> None:
    """Write with a fixed column order, optionally partitioned so later scans prune."""
    out = df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def dynamic_table(frames: list[DataFrame]) -> DataFrame:
    """Union of frames with different columns: all columns, sorted by name, missing ones NULL."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*sorted(out.columns))


def json_safe(col: str, dtype: str) -> Column:
    """NaN and infinities have no JSON form and become NULL."""
    c = F.col(f"`{col}`")
    if dtype in ("double", "float"):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c).alias(col)
    return c.alias(col)


def json_report(df: DataFrame, *, name: str = "report") -> DataFrame:
    """One JSON text per row."""
    cells = [json_safe(c, t) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias(name))


def write_json_report(df: DataFrame, path: str) -> None:
    cells = df.select(*[json_safe(c, t) for c, t in df.dtypes])
    cells.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_splits(df: DataFrame, root: str, *, split: str, fmt: str = "parquet") -> dict[str, str]:
    """The train and the test sink of a merge: one table for each, without the split column. Returns their paths.

    Rows of another split, or of none, are not lost: where there are any they go to a third table, ``other``, with the column.
    """
    names = ("train", "test")
    paths = {name: f"{root.rstrip('/')}/{name}" for name in names}
    for name, path in paths.items():
        write_table(df.where(F.col(split) == name).drop(split), path, fmt=fmt)
    other = df.where(F.coalesce(~F.col(split).isin(*names), F.lit(True)))
    if not other.isEmpty():
        paths["other"] = f"{root.rstrip('/')}/other"
        write_table(other, paths["other"], fmt=fmt)
    return paths


def replay_key(params: dict) -> str:
    """Stable key of a replay request."""

    def clean(v):
        return None if isinstance(v, float) and not math.isfinite(v) else v

    text = json.dumps({k: clean(v) for k, v in params.items()}, sort_keys=True)
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def input_state(spark: SparkSession, path: str) -> list[list]:
    """Name, length and modification time of all files below a path, from the listing; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select("path", "length", F.unix_micros("modificationTime")).collect()
    return sorted(list(r) for r in rows)


def _stored(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def materialize_replay(spark: SparkSession, build, root: str, params: dict, inputs: list[str]) -> DataFrame:
    """Return the stored replay of these parameters and input files, building and storing it the first time.

    A mark is written when the table is whole, so that one whose writer died is built again.
    """
    key = replay_key({**params, "__inputs": [input_state(spark, p) for p in inputs]})
    path = f"{root.rstrip('/')}/replay_{key}"
    if not _stored(spark, f"{path}/ready"):
        build().write.mode("overwrite").parquet(f"{path}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/ready")
    return spark.read.parquet(f"{path}/rows")
