"""Replay orders, ticks, running counts and alert feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.base import MODELS, PROTOCOLS, THRESHOLDS, flows, query, rounded, row_hash_sql
from flowlens.functions.coerce import classify_outcome
from flowlens.operators import combine, replay
from flowlens.operators.score import routed_score

SEED = 7
OUTCOME = """CASE WHEN label = 1 AND prediction = 1 THEN 'TP' WHEN label = 0 AND prediction = 0 THEN 'TN'
  WHEN label = 0 THEN 'FP' ELSE 'FN' END"""


# W-20
@query("""SELECT source_row_index, protocol_hint, attack_family FROM flows QUALIFY row_number() OVER (
  PARTITION BY protocol_hint, attack_family ORDER BY source_row_index) <= 40""", ("flows",))
def first_n_per_group(spark, sf):
    f = flows(spark, sf).select("source_row_index", "protocol_hint", "attack_family")
    return replay.first_n_per_group(f, by=["protocol_hint", "attack_family"], order=["source_row_index"], n=40)


# P-22, P-17
@query(f"""SELECT source_row_index, printf('%s_%s_%03d', protocol_hint, o, rn) AS case_id FROM (SELECT source_row_index,
    protocol_hint, {OUTCOME} AS o, row_number() OVER (PARTITION BY protocol_hint, {OUTCOME} ORDER BY source_row_index) AS rn
  FROM flows) WHERE rn <= 12""", ("flows",))
def case_ids(spark, sf):
    f = flows(spark, sf).withColumn("o", classify_outcome("label", "prediction"))
    return replay.case_ids(f, protocol="protocol_hint", outcome="o", order=[F.col("source_row_index")], n=12).select(
        "source_row_index", "case_id"
    )


INTER = f"""t AS (SELECT *, row_number() OVER (PARTITION BY source_relpath ORDER BY source_row_index) AS turn FROM flows),
  inter AS (SELECT *, row_number() OVER (ORDER BY turn, {row_hash_sql("source_relpath", seed=SEED)}, source_relpath) AS replay_pos
    FROM t)"""


# W-22
@query(f"WITH {INTER} SELECT source_row_index, replay_pos FROM inter", ("flows",))
def round_robin_interleave(spark, sf):
    f = flows(spark, sf).select("source_relpath", "source_row_index")
    out = replay.interleave(f, by=["source_relpath"], order=[F.col("source_row_index")], seed=SEED)
    return out.select("source_row_index", "replay_pos")


# W-22 nested, W-23
@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY protocol_hint, source_relpath ORDER BY source_row_index) AS turn
      FROM flows), w AS (SELECT *, row_number() OVER (PARTITION BY protocol_hint ORDER BY turn,
      {row_hash_sql("source_relpath", seed=SEED)}, source_relpath) AS step FROM t)
  SELECT source_row_index, row_number() OVER (ORDER BY step, {row_hash_sql("protocol_hint", seed=SEED)}, protocol_hint)
    AS replay_pos FROM w""", ("flows",))
def replay_order_nested(spark, sf):
    f = flows(spark, sf).select("protocol_hint", "source_relpath", "source_row_index")
    out = replay.replay_order(
        f,
        mode="interleave-protocol-source",
        key="source_row_index",
        source="source_relpath",
        protocol="protocol_hint",
        seed=SEED,
    )
    return out.select("source_row_index", "replay_pos")


# W-23
@query(f"""SELECT source_row_index, row_number() OVER (ORDER BY {row_hash_sql("source_row_index", seed=SEED)}, source_row_index)
  AS shuffled, row_number() OVER (ORDER BY source_row_index) AS sequential FROM flows""", ("flows",))
def replay_order_modes(spark, sf):
    f = flows(spark, sf).select("source_relpath", "protocol_hint", "source_row_index")
    args = {"key": "source_row_index", "source": "source_relpath", "protocol": "protocol_hint", "seed": SEED}
    a = replay.replay_order(f, mode="shuffle", name="shuffled", **args)
    b = replay.replay_order(f, mode="sequential", name="sequential", **args)
    return a.select("source_row_index", "shuffled").join(b.select("source_row_index", "sequential"), "source_row_index")


FRONT = f"""s AS (SELECT *, round(score - threshold, 9) AS margin, abs(round(score - threshold, 9)) AS abs_margin FROM flows),
  d AS (SELECT *, row_number() OVER (PARTITION BY protocol_hint ORDER BY abs_margin, score, source_row_index) AS rp FROM s
    WHERE prediction = 1 AND score >= threshold AND score < 0.9999::DOUBLE),
  a AS (SELECT * FROM d WHERE rp <= 100), n AS (SELECT greatest(0, 300 - count(*)) AS need FROM a),
  b AS (SELECT d.*, row_number() OVER (ORDER BY abs_margin, score, source_row_index) AS rg FROM d WHERE rp > 100),
  pre AS (SELECT source_row_index, protocol_hint, source_relpath FROM a UNION ALL
    SELECT source_row_index, protocol_hint, source_relpath FROM b, n WHERE rg <= need),
  t1 AS (SELECT *, row_number() OVER (PARTITION BY protocol_hint, source_relpath ORDER BY source_row_index) AS turn FROM pre),
  t2 AS (SELECT *, row_number() OVER (PARTITION BY protocol_hint ORDER BY turn, {row_hash_sql("source_relpath", seed=SEED)},
    source_relpath) AS step FROM t1),
  t3 AS (SELECT source_row_index, row_number() OVER (ORDER BY step, {row_hash_sql("protocol_hint", seed=SEED)}, protocol_hint)
    AS replay_pos FROM t2)"""


# W-24
@query(f"""WITH {FRONT} SELECT source_row_index, replay_pos FROM t3 UNION ALL
  SELECT source_row_index, (SELECT count(*) FROM t3) + row_number() OVER (ORDER BY source_row_index) FROM flows
  WHERE source_row_index NOT IN (SELECT source_row_index FROM t3)""", ("flows",))
def front_load_alerts(spark, sf):
    m = F.round(F.col("score") - F.col("threshold"), 9)
    f = flows(spark, sf).withColumn("abs_margin", F.abs(m))
    f = f.select(
        "source_row_index", "source_relpath", "protocol_hint", "score", "threshold", "prediction", "abs_margin"
    )
    out = replay.front_load_alerts(
        f,
        protocol="protocol_hint",
        protocols=PROTOCOLS,
        source="source_relpath",
        key="source_row_index",
        n=300,
        seed=SEED,
        score="score",
    )
    return out.select("source_row_index", "replay_pos")


def ticked(spark, sf):
    f = flows(spark, sf).select(
        "source_relpath", "source_row_index", "protocol_hint", "attack_family", "prediction", "score"
    )
    out = replay.interleave(f, by=["source_relpath"], order=[F.col("source_row_index")], seed=SEED)
    return out.withColumn("tick", replay.tick_assign("replay_pos", 8))


TICK = f"{INTER}, tk AS (SELECT *, CAST(floor((replay_pos - 1) / 8::DOUBLE) AS BIGINT) + 1 AS tick FROM inter)"


# W-25
@query(f"WITH {TICK} SELECT source_row_index, tick FROM tk", ("flows",))
def tick_assign(spark, sf):
    return ticked(spark, sf).select("source_row_index", "tick")


# W-26
@query(f"""WITH {TICK}, g AS (SELECT protocol_hint, tick, count(*) AS flows, count(*) FILTER (WHERE prediction = 1) AS alerts
    FROM tk GROUP BY 1, 2)
  SELECT *, CAST(sum(flows) OVER w AS BIGINT) AS cum_flows, CAST(sum(alerts) OVER w AS BIGINT) AS cum_alerts FROM g
  WINDOW w AS (PARTITION BY protocol_hint ORDER BY tick ROWS UNBOUNDED PRECEDING)""", ("flows",))
def running_counts(spark, sf):
    return replay.running_counts(ticked(spark, sf), by=["protocol_hint"], tick="tick")


# ST-06, batch twin
@query(f"""WITH {TICK} SELECT source_row_index, tick FROM (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY replay_pos) AS rn
    FROM tk WHERE prediction = 1) WHERE rn <= 50 ORDER BY tick DESC, replay_pos LIMIT 250""", ("flows",))
def recent_alerts(spark, sf):
    out = replay.recent_alerts(ticked(spark, sf), tick="tick", pos="replay_pos", cap=250, per_tick=50)
    return out.select("source_row_index", "tick")


# ST-05, batch twin
@query(f"""WITH {TICK} SELECT tick, replay_pos, source_row_index FROM tk WHERE prediction = 1 ORDER BY replay_pos LIMIT 1""",
       ("flows",))
def first_alert(spark, sf):
    out = replay.first_alert(ticked(spark, sf), order="replay_pos", columns=["tick", "source_row_index"])
    return out.select("tick", "replay_pos", "source_row_index")


# ST-04, batch twin
@query("""SELECT protocol_hint, count(*) AS flows, count(*) FILTER (WHERE prediction = 1) AS alerts,
  round(count(*) FILTER (WHERE prediction = 1) / count(*)::DOUBLE, 6) AS alert_ratio FROM flows GROUP BY 1""", ("flows",))
def session_counters(spark, sf):
    return rounded(replay.session_counters(flows(spark, sf), protocol="protocol_hint"))


# A-35
@query("""SELECT attack_family, count(*) FILTER (WHERE prediction = 1) AS alerts,
    round(coalesce(quantile_cont(score, 0.1) FILTER (WHERE prediction = 1), 0), 6) AS q10,
    round(coalesce(quantile_cont(score, 0.5) FILTER (WHERE prediction = 1), 0), 6) AS q50,
    round(coalesce(quantile_cont(score, 0.9) FILTER (WHERE prediction = 1), 0), 6) AS q90 FROM flows GROUP BY 1""", ("flows",))
def alert_quantiles(spark, sf):
    return rounded(replay.alert_quantiles(flows(spark, sf), by="attack_family", score="score"))


# A-36
@query("""SELECT protocol_used, count(*) AS scored_rows, count(*) FILTER (WHERE prediction = 1) AS alerts,
  count(*) FILTER (WHERE prediction = 1 AND score_attack < 0.9999::DOUBLE) AS non_saturated_alerts FROM scored GROUP BY 1""",
  ("flows", "scored"))
def sweep_counts(spark, sf):
    return replay.sweep_counts(routed_score(flows(spark, sf), MODELS, THRESHOLDS), by="protocol_used")


# W-19
@query("""SELECT protocol_hint, attack_family AS feature, n, round(m, 6) AS m, row_number() OVER (PARTITION BY protocol_hint
    ORDER BY n DESC, m DESC, attack_family) AS rank
  FROM (SELECT protocol_hint, attack_family, count(*) AS n, avg(score) AS m FROM flows GROUP BY 1, 2)""", ("flows",))
def rank_features(spark, sf):
    g = flows(spark, sf).groupBy("protocol_hint", F.col("attack_family").alias("feature")).agg(
        F.count("*").alias("n"), F.avg("score").alias("m")
    )
    return rounded(combine.rank_features(g, by="protocol_hint", primary="n", secondary="m"))
