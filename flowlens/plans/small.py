"""Small side tables (thresholds, quotas, per-stratum cut-offs) and lineage cuts."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MAX_PINNED_ROWS = 20_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys; the right-hand key columns are dropped."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right
    for i, key in enumerate(keys):
        renamed = renamed.withColumnRenamed(key, f"__k{i}")
    cond: Column | None = None
    for i, key in enumerate(keys):
        part = left[key].eqNullSafe(renamed[f"__k{i}"])
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, how).drop(*[f"__k{i}" for i in range(len(keys))])


def pinned(df: DataFrame, max_rows: int = MAX_PINNED_ROWS) -> DataFrame:
    """Evaluate a table that is expected to be tiny once and put it back into plans as a local relation.

    At most ``max_rows + 1`` rows ever reach the driver. A table within the bound becomes a local relation, so
    Spark knows its true size when it picks the join; a larger one keeps its own plan, is written to reliable
    storage, and is joined without any hint.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows:
        return local(df.sparkSession, head, df.schema)
    return cut_lineage(df)


def local(spark: SparkSession, rows: pa.Table, schema: T.StructType) -> DataFrame:
    """A local relation. Rows of Python objects would become a scan of unknown size, which is joined by a sort that sends
    all rows of a hot key to one task; an Arrow table has a size, and small ones are broadcast by it."""
    return spark.createDataFrame(rows, schema)


def small_enough(df: DataFrame, max_rows: int = MAX_PINNED_ROWS) -> DataFrame:
    """Broadcast ``df`` only when a bounded count proves it small; otherwise hand it back unhinted."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def spread_out(df: DataFrame) -> DataFrame:
    """Rows of a few files over all cores, before work that costs much more a row than moving it.

    A small file is one task however many cores there are. A table of at least a file for each core stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def once_per_row(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row.

    Spark may inline a projected column into every place that uses it, also into the body of a higher-order function,
    where it would be evaluated per element. A one-element generator keeps the values apart.
    """
    kept = [c for c in df.columns if c not in columns]
    cells = F.struct(*[v.alias(k) for k, v in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(cells)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a scratch folder in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to storage shared by all executors")
    path = tempfile.mkdtemp(prefix="flowlens-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
