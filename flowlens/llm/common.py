"""Shared pieces of the training-data operators: word rules, stable hashes, keys that survive odd tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed: what separates words, as a class for Java's and for Python's regular expressions.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session rows now go to Python in batches of about 4 MB, unless the session has a limit of its own.

    By Spark's default (64 MB) a whole partition of texts is one batch, which the executor and its worker hold several times
    over; a reused worker keeps much of that for the tasks after it. No operator's result depends on batches.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, "4m")
    return df


def whole_text(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % F.lit(folds)


def unit_hash(*columns: Column, seed: int = 0) -> Column:
    """A stable number in [0, 1) of the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def row_hash(text: str = "text", doc_id: str = "doc_id") -> Column:
    """A name for a row by its id and text that is there also where the id is null or repeated."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))


def fresh(df: DataFrame, wanted: str) -> str:
    """``wanted``, made longer until no column of ``df`` has that name (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def windows_of(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """Cut a very long text into pieces of ``size`` characters, each with ``overlap`` characters of what follows."""
    for start in range(0, max(1, len(text)), size):
        yield start, text[start : start + size + overlap]
