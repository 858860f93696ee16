"""The streaming operators, run over the whole events table as a file stream and checked against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowlens.catalog.base import FEATURES, MODELS, THRESHOLDS, flows, flows_of, query, rounded, table
from flowlens.plans.small import shared_dir
from flowlens.streaming import alerts as A


def flow_stream(spark, sf):
    events = A.flow_stream(spark, sf, schema=table(spark, sf, "events").schema, glob="events.parquet")
    return flows_of(events).select(
        "source_relpath", "source_row_index", "ts", "protocol_hint", "attack_family", "label", *FEATURES
    )


def scored_stream(spark, sf):
    return A.stream_score(flow_stream(spark, sf), MODELS, THRESHOLDS)


# ST-01
@query("SELECT source_row_index, protocol_used, round(score_attack, 6) AS score_attack, prediction FROM scored", ("flows", "scored"))
def stream_score(spark, sf):
    cols = ["source_row_index", "protocol_used", "score_attack", "prediction"]
    return rounded(A.drain(scored_stream(spark, sf).select(*cols)))


# ST-02: contributions of equal size rank by name, as in linear_contributions
@query("""SELECT source_row_index, attack_family, round(score_attack, 6) AS score_attack, round(margin, 6) AS margin,
    3 AS parts, CASE WHEN abs(w_hr * hr) >= abs(w_k * k) AND abs(w_hr * hr) >= abs(w_value * value) THEN 'hr'
      WHEN abs(w_k * k) >= abs(w_value * value) THEN 'k' ELSE 'value' END AS top_feature
  FROM scored WHERE prediction = 1""", ("flows", "scored"))
def alert_stream(spark, sf):
    out = A.drain(A.alert_stream(scored_stream(spark, sf), MODELS, keep=["source_row_index", "attack_family"]))
    return rounded(
        out.select(
            "source_row_index",
            "attack_family",
            "score_attack",
            "margin",
            F.size("local_explanation").alias("parts"),
            F.get("local_explanation", F.lit(0))["feature"].alias("top_feature"),
        )
    )


TICKS = """SELECT date_trunc('hour', ts) AS tick_start, count(*) AS flows, CAST(sum(prediction) AS BIGINT) AS alerts,
  round(sum(prediction) / count(*)::DOUBLE, 6) AS alert_ratio FROM scored GROUP BY 1"""


# ST-03: complete output of the stream equals the batch windows
@query(TICKS, ("flows", "scored"))
def stream_tick_rollup(spark, sf):
    s = scored_stream(spark, sf).select("ts", "prediction")
    return rounded(A.drain(A.tick_rollup(s, ts="ts", watermark="1 hour", width="1 hour"), mode="complete"))


# ST-03, batch twin
@query(TICKS, ("flows", "scored"))
def tick_rollup(spark, sf):
    s = A.stream_score(flows(spark, sf), MODELS, THRESHOLDS).select("ts", "prediction")
    return rounded(A.tick_rollup(s, ts="ts", width="1 hour"))


# ST-04
@query("""SELECT protocol_used, count(*) AS flows, CAST(sum(prediction) AS BIGINT) AS alerts,
  round(sum(prediction) / count(*)::DOUBLE, 6) AS alert_ratio FROM scored GROUP BY 1""", ("flows", "scored"))
def stream_session_counters(spark, sf):
    s = scored_stream(spark, sf).select("protocol_used", "prediction")
    return rounded(A.drain(A.session_rollup(s, by="protocol_used"), mode="complete"))


# ST-05
@query("SELECT min(ts) AS first_alert FROM scored WHERE prediction = 1", ("flows", "scored"))
def stream_first_alert(spark, sf):
    s = scored_stream(spark, sf).select("ts", "prediction")
    return A.drain(A.first_alert_rollup(s, order="ts"), mode="complete")


# ST-06
@query("""SELECT source_row_index, ts FROM scored WHERE prediction = 1 ORDER BY ts DESC, source_row_index DESC LIMIT 250""",
       ("flows", "scored"))
def stream_recent_alerts(spark, sf):
    s = scored_stream(spark, sf).where(F.col("prediction") == 1).select("source_row_index", "ts")
    return A.drain_recent(s, order=["ts", "source_row_index"], cap=250)


# ST-07: every row is replayed twice, the newest quarter first and two files a trigger, and comes out once
@query("SELECT source_relpath, source_row_index FROM flows", ("flows",))
def stream_dedupe_replay(spark, sf):
    rows = flows(spark, sf).select("source_relpath", "source_row_index", "ts")
    root = f"{shared_dir(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    quarter = F.quarter("ts")
    for q in (4, 3, 2, 1, 4, 2, 1, 3):
        rows.where(quarter == q).write.mode("append").parquet(root)
    s = A.flow_stream(spark, root, schema=rows.schema, glob="*.parquet", files_per_trigger=2)
    return A.drain(A.dedupe_replay(s.select("source_relpath", "source_row_index"), key=["source_relpath", "source_row_index"]))
