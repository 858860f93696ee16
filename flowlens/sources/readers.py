"""Reading flow tables and paging through them."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowlens.functions.paths import is_capture_path, with_path_metadata
from flowlens.plans.ordered import rank_rows
from flowlens.schema import require_columns


def read_flows_parquet(
    spark: SparkSession, path: str, *, schema: T.StructType | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Parquet flows; unread columns never leave the files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if columns is None else project_scan(df, columns)


def read_flows_csv(
    spark: SparkSession, path: str | list[str], *, schema: T.StructType, columns: list[str] | None = None,
    source: str | None = None,
) -> DataFrame:
    """Header CSV with a declared schema, columns matched by name in every file.

    A file without one of the columns is an error, extra columns are dropped. Files are grouped by their header (a few
    layouts, whatever the number of files), as one scan reads one layout. Text is kept first and cast leniently, so
    undecodable or non-numeric cells become NULL instead of failing. ``source`` names a column for each row's file.
    """
    if source is not None:
        columns = [*(columns or schema.fieldNames()), source]
    parts = []
    for header, files in csv_layouts(spark, path):
        require_columns(header, schema.fieldNames())
        raw = spark.read.schema(T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(header))]))
        raw = raw.option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(files)
        at = {name: f"_{i}" for i, name in enumerate(header)}
        cells = [F.col(at[f.name]).try_cast(f.dataType).alias(f.name) for f in schema.fields]
        parts.append(raw.select(*cells, *([_file().alias(source)] if source else [])))
    if not parts:
        empty = spark.createDataFrame([], schema)
        parts.append(empty.withColumn(source, F.lit(None).cast("string")) if source else empty)
    typed = reduce(DataFrame.unionByName, parts)
    return typed if columns is None else project_scan(typed, columns)


def _file() -> Column:
    """The file of a row, as it is named in a listing (the metadata column holds it in URI form)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def bare(path: Column) -> Column:
    """A path without scheme and authority."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")


def relative(path: Column, root: str) -> Column:
    """The part of a path below ``root``; either may carry a scheme. A path that is not below it comes back whole."""
    top = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "", root)
    top = re.sub("/+", "/", top).rstrip("/") + "/"
    plain = F.regexp_replace(bare(path), "/+", "/")
    return F.when(plain.startswith(top), F.substr(plain, F.lit(len(top) + 1))).otherwise(plain)


def csv_layouts(spark: SparkSession, path: str | list[str]) -> list[tuple[list[str], list[str]]]:
    """``(header, files)`` for each distinct header line below a path: the first line of every file, read by Spark.

    One row for each layout comes to the driver with the names of its files, as a file listing does. A file's first line is
    the first row of the task that holds its start.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if not paths:
        return []
    start = F.col("_metadata.file_block_start")
    lines = spark.read.text(paths).select("value", _file().alias("file"), start.alias("block"))
    first = lines.where("block = 0").groupBy("file").agg(F.first("value").alias("header"))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    names = []
    for row in sorted(found, key=lambda r: r["files"][0]):
        text = row["header"].removeprefix("\ufeff")
        names.append(([c.strip() for c in next(csv.reader([text]))], row["files"]))
    return names


def discover_captures(spark: SparkSession, root: str, *, exclude: str | None = None) -> DataFrame:
    """Capture files under a root (a path or a URI) with their relative path; names only, no contents are read.

    Scheme and authority are taken off both the listing and the root, so that either may carry them.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .load(root)
        .select(bare(F.col("path")).alias("file_path"), F.col("length").alias("bytes"), F.col("path").alias("uri"))
    )
    rel = relative(F.col("file_path"), root)
    out = files.withColumn("source_relpath", rel).where(is_capture_path(rel))
    return out if exclude is None else out.where(~F.col("source_relpath").startswith(exclude))


def filter_captures(df: DataFrame, *, path: str) -> DataFrame:
    """The discovery rule over a column of paths."""
    return df.where(is_capture_path(path))


def project_scan(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df.columns, columns)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns both tables have, in the order of the left one."""
    have = set(right.columns)
    return [c for c in left.columns if c in have]


def limit_scan(df: DataFrame, *, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def read_window(df: DataFrame, *, order: list[Column | str], start: int, n: int) -> DataFrame:
    """One page of ``n`` rows after skipping ``start``."""
    return df.orderBy(*order).offset(start).limit(n)


def preview(df: DataFrame, *, order: list[Column | str], n: int = 2000) -> DataFrame:
    return df.orderBy(*order).limit(n)


def merge_captures(df: DataFrame, *, path: str, order: list[Column | str], test_percent: int = 20) -> DataFrame:
    """Attach path metadata to every row and number rows inside each capture from 1 (numeric leading order key)."""
    numbered = rank_rows(df, [path], order, "source_row_index")
    return with_path_metadata(numbered, path, test_percent)


def merge_stats(df: DataFrame, *, capture: str, split: str, is_attack: str) -> DataFrame:
    """Files, rows, attack and benign rows per split; captures collapse first, then splits."""
    per_file = df.groupBy(split, capture).agg(
        F.count("*").alias("rows"), F.count(F.when(F.col(is_attack) == 1, F.lit(1))).alias("attack_rows")
    )
    return per_file.groupBy(split).agg(
        F.count("*").alias("files"),
        F.sum("rows").alias("rows_total"),
        F.sum("attack_rows").alias("attack_rows"),
        (F.sum("rows") - F.sum("attack_rows")).alias("benign_rows"),
    )
