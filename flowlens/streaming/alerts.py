"""Scored streams: alerts, tick roll-ups, session counters, first and recent alerts, replay de-duplication.

Every transformation is a plain ``DataFrame -> DataFrame`` function that works on a stream and on a table alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.operators.score import LinearModel, contributions, routed_score, top_contributions
from flowlens.plans.small import shared_dir


def flow_stream(spark: SparkSession, root: str, *, schema: T.StructType, glob: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", glob)
        .parquet(root)
    )


def stream_score(df: DataFrame, models: dict[str, LinearModel], thresholds: dict[str, float]) -> DataFrame:
    """Route, score and threshold; stateless."""
    return routed_score(df, models, thresholds)


def alert_stream(df: DataFrame, models: dict[str, LinearModel], *, keep: list[str], top: int = 3) -> DataFrame:
    """Alerts only, each with its strongest contributions."""
    alerts = contributions(df.where(F.col("prediction") == 1), models, name="local_explanation")
    return alerts.select(
        *keep,
        "protocol_used",
        "score_attack",
        "threshold",
        "margin",
        top_contributions("local_explanation", top).alias("local_explanation"),
    )


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned timestamp; a local one is read in the session time zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tick_rollup(df: DataFrame, *, ts: str, watermark: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Rows, alerts and alert ratio per tumbling window; the watermark bounds the state."""
    kind = df.schema[ts].dataType
    agg = (
        _event_time(df, ts)
        .withWatermark(ts, watermark)
        .groupBy(F.window(ts, width).alias("w"))
        .agg(F.count("*").alias("flows"), F.sum("prediction").alias("alerts"))
    )
    return agg.select(
        F.col("w.start").cast(kind).alias("tick_start"), "flows", "alerts", (F.col("alerts") / F.col("flows")).alias("alert_ratio")
    )


def session_rollup(df: DataFrame, *, by: str) -> DataFrame:
    """Cumulative flows and alerts per group; update or complete mode on a stream."""
    agg = df.groupBy(by).agg(F.count("*").alias("flows"), F.sum("prediction").alias("alerts"))
    return agg.withColumn("alert_ratio", F.when(F.col("flows") > 0, F.col("alerts") / F.col("flows")).otherwise(0.0))


def first_alert_rollup(df: DataFrame, *, order: str) -> DataFrame:
    return df.where(F.col("prediction") == 1).agg(F.min(order).alias("first_alert"))


def dedupe_replay(df: DataFrame, *, key: list[str]) -> DataFrame:
    """Each row identity once, so a restarted replay does not count twice, however late a row comes.

    A watermark would drop rows that were never seen when they are later than it, so the state holds every key. Its size
    is that of the keys: use the RocksDB state store for long replays.
    """
    return df.dropDuplicates(key)


def recent_alerts_sink(path: str, *, order: list[str], cap: int) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler that keeps the newest ``cap`` alerts of all batches so far.

    Each batch writes one small table, named by the batch, from the previous one and its own newest alerts, so a
    repeated batch writes the same table again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        newest = batch.orderBy(*[F.col(c).desc() for c in order]).limit(cap)
        if batch_id > 0:
            newest = newest.unionByName(batch.sparkSession.read.parquet(f"{path}/batch={batch_id - 1}"))
            newest = newest.orderBy(*[F.col(c).desc() for c in order]).limit(cap)
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return merge


def drain(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """Run a stream over all available input and return its output as a table in the shared folder.

    Append streams write parquet directly. Complete and update streams write each trigger's result under its batch
    number; complete mode reads back the last one.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out, state = f"{base}/out", f"{base}/state"
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    last: list[int] = []

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id}")
        last.append(batch_id)

    query = writer.outputMode(mode).foreachBatch(put).start()
    query.awaitTermination()
    if not last:  # no input, so no trigger ran
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/{max(last)}")


def drain_recent(stream: DataFrame, *, order: list[str], cap: int) -> DataFrame:
    """Run a stream of alerts through ``recent_alerts_sink`` and return the final feed."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    seen: list[int] = []
    merge = recent_alerts_sink(f"{base}/out", order=order, cap=cap)

    def put(batch: DataFrame, batch_id: int) -> None:
        merge(batch, batch_id)
        seen.append(batch_id)

    query = (
        stream.writeStream.option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .outputMode("append")
        .foreachBatch(put)
        .start()
    )
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/out/batch={max(seen)}")
