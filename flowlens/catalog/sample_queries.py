"""Validation splits and stratified samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.base import PROTOCOLS, flows, line_flows, query, rounded, row_hash_sql, table
from flowlens.operators import sample, split

KEY = ["source_row_index"]
SEED = 42
H = row_hash_sql("source_row_index", seed=SEED)


# R-01
@query(f"""SELECT source_row_index, {row_hash_sql("source_relpath", "source_row_index", seed=SEED)} % 5 = 0 AS is_val
  FROM flows""", ("flows",))
def hash_val_split_row(spark, sf):
    out = split.hash_val_split_row(flows(spark, sf), key=["source_relpath", "source_row_index"], seed=SEED)
    return out.select("source_row_index", "is_val")


def coarse_captures(spark, sf):
    """Flows with captures that are uneven on purpose: mqtt/0 sits in one capture, bluetooth/0 in two that collapse."""
    single = (F.col("protocol_hint") == "mqtt") & (F.col("label") == 0)
    pair = (F.col("protocol_hint") == "bluetooth") & (F.col("label") == 0)
    cap = (
        F.when(single, F.lit("mqtt_all"))
        .when(pair, F.when(F.col("k") < 10, F.lit("bt_e")).otherwise(F.lit("bt_b")))
        .otherwise(F.col("source_relpath"))
    )
    return flows(spark, sf).select("protocol_hint", "label", "source_row_index", cap.alias("cap"))


COARSE = """cc AS (SELECT protocol_hint, label, source_row_index, CASE WHEN protocol_hint = 'mqtt' AND label = 0 THEN 'mqtt_all'
    WHEN protocol_hint = 'bluetooth' AND label = 0 THEN CASE WHEN k < 10 THEN 'bt_e' ELSE 'bt_b' END
    ELSE source_relpath END AS cap FROM flows)"""


def val_split_sql(rebalance: str) -> str:
    by_capture = "files >= 2" if rebalance == "capture" else "false"
    return f"""{COARSE}, caps AS (SELECT protocol_hint, label, cap, count(*) AS n,
      {row_hash_sql("cap", seed=SEED)} % 5 = 0 AS v, row_number() OVER (PARTITION BY protocol_hint, label
        ORDER BY {row_hash_sql("cap", "'rebalance'", seed=SEED)}) AS rn FROM cc GROUP BY 1, 2, 3),
    st AS (SELECT protocol_hint, label, sum(n) AS n, count(*) AS files, count(*) FILTER (WHERE v) AS nv FROM caps GROUP BY 1, 2),
    md AS (SELECT *, CASE WHEN n <= 1 THEN 'train' WHEN nv > 0 AND nv < files THEN 'hash'
        WHEN {by_capture} THEN 'file_level_rebalance' ELSE 'row_level_single_file' END AS mode FROM st),
    rws AS (SELECT cc.*, row_number() OVER (PARTITION BY protocol_hint, label
        ORDER BY {row_hash_sql("cap", "source_row_index", "'row'", seed=SEED)}) AS rrn FROM cc),
    marked AS (SELECT r.protocol_hint, r.label, r.source_row_index, CASE md.mode WHEN 'hash' THEN caps.v
        WHEN 'file_level_rebalance' THEN caps.rn <= greatest(1, least(files - 1, round_even(files / 5::DOUBLE, 0)))
        WHEN 'row_level_single_file' THEN r.rrn <= greatest(1, least(md.n - 1, round_even(md.n / 5::DOUBLE, 0)))
        ELSE false END AS is_val
      FROM rws r JOIN caps ON caps.protocol_hint = r.protocol_hint AND caps.label = r.label AND caps.cap = r.cap
        JOIN md ON md.protocol_hint = r.protocol_hint AND md.label = r.label)"""


# R-03
@query(f"WITH {val_split_sql('capture')} SELECT source_row_index, is_val FROM marked", ("flows",))
def leakguard_val_split(spark, sf):
    out, _ = split.capture_val_split(
        coarse_captures(spark, sf), strata=["protocol_hint", "label"], capture="cap", row="source_row_index", seed=SEED
    )
    return out.select("source_row_index", "is_val")


# R-03: fallback events
@query(f"""WITH {val_split_sql('capture')} SELECT md.protocol_hint, md.label, CAST(md.n AS BIGINT) AS stratum_rows,
    md.files AS stratum_files, md.mode AS fallback_type, a.v AS val_rows_after_split, CAST(md.n - a.v AS BIGINT) AS train_rows_after_split
  FROM md JOIN (SELECT protocol_hint, label, count(*) FILTER (WHERE is_val) AS v FROM marked GROUP BY 1, 2) a
    ON a.protocol_hint = md.protocol_hint AND a.label = md.label
  WHERE md.mode IN ('file_level_rebalance', 'row_level_single_file')""", ("flows",))
def leakguard_fallback_events(spark, sf):
    _, events = split.capture_val_split(
        coarse_captures(spark, sf), strata=["protocol_hint", "label"], capture="cap", row="source_row_index", seed=SEED
    )
    return events


# R-02
@query(f"WITH {val_split_sql('row')} SELECT source_row_index, is_val FROM marked", ("flows",))
def hash_val_split_capture(spark, sf):
    out, _ = split.capture_val_split(
        coarse_captures(spark, sf),
        strata=["protocol_hint", "label"],
        capture="cap",
        row="source_row_index",
        seed=SEED,
        rebalance="row",
    )
    return out.select("source_row_index", "is_val")


# R-04
@query(f"""WITH s AS (SELECT source_relpath, source_row_index, protocol_hint, label, value >= 20 AS is_val FROM flows),
    m AS (SELECT *, count(*) OVER (PARTITION BY source_relpath) AS c FROM s
      WHERE protocol_hint = 'bluetooth' AND label = 0 AND is_val),
    r AS (SELECT source_row_index, row_number() OVER (ORDER BY c DESC, {row_hash_sql("source_relpath", seed=SEED)}, source_relpath,
        {row_hash_sql("source_relpath", "source_row_index", "'floor'", seed=SEED)}, source_row_index) AS rn FROM m),
    t AS (SELECT least(greatest(0, floor(0.7::DOUBLE * count(*)) - count(*) FILTER (WHERE NOT is_val)),
        count(*) FILTER (WHERE is_val) - 1) AS move FROM s WHERE protocol_hint = 'bluetooth' AND label = 0)
  SELECT s.source_row_index, CASE WHEN r.rn <= t.move THEN false ELSE s.is_val END AS is_val
  FROM s LEFT JOIN r ON r.source_row_index = s.source_row_index CROSS JOIN t""", ("flows",))
def train_floor(spark, sf):
    f = flows(spark, sf).select(
        "source_relpath", "source_row_index", "protocol_hint", "label", (F.col("value") >= 20).alias("is_val")
    )
    stratum = (F.col("protocol_hint") == "bluetooth") & (F.col("label") == 0)
    floor = int(0.7 * f.where(stratum).count())
    out = split.train_floor(
        f, stratum=stratum, capture="source_relpath", row="source_row_index", floor=floor, seed=SEED
    )
    return out.select("source_row_index", "is_val")


# R-04: the event of the floor
@query("""WITH s AS (SELECT value >= 20 AS is_val FROM flows WHERE protocol_hint = 'bluetooth' AND label = 0),
    n AS (SELECT CAST(floor(0.7::DOUBLE * count(*)) AS BIGINT) AS floor, count(*) FILTER (WHERE NOT is_val) AS train,
      count(*) FILTER (WHERE is_val) AS val FROM s),
    m AS (SELECT *, greatest(0, least(greatest(0, floor - train), val - 1)) AS moved FROM n)
  SELECT floor AS floor_target, moved > 0 AS floor_applied, train AS train_rows_before_floor, val AS val_rows_before_floor,
    train + moved AS train_rows_after_floor, val - moved AS val_rows_after_floor, moved AS rows_moved FROM m""", ("flows",))
def train_floor_event(spark, sf):
    f = flows(spark, sf).select(
        "source_relpath", "source_row_index", "protocol_hint", "label", (F.col("value") >= 20).alias("is_val")
    )
    stratum = (F.col("protocol_hint") == "bluetooth") & (F.col("label") == 0)
    floor = int(0.7 * f.where(stratum).count())
    out = split.train_floor(f, stratum=stratum, capture="source_relpath", row="source_row_index", floor=floor, seed=SEED)
    return split.train_floor_event(f, out, stratum=stratum, floor=floor)


# R-06
@query(f"""SELECT source_row_index, label FROM flows
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY {H}, source_row_index) <= 300""", ("flows",))
def reservoir_per_class(spark, sf):
    out = sample.reservoir_per_class(flows(spark, sf), label="label", k=300, key=KEY, seed=SEED)
    return out.select("source_row_index", "label")


# R-07
@query(f"SELECT source_row_index FROM flows WHERE {H} < {int(0.06 * float(1 << 60))}", ("flows",))
def bernoulli_sample(spark, sf):
    return sample.bernoulli_sample(flows(spark, sf), key=KEY, rate=0.06, seed=SEED).select("source_row_index")


def targets_sql(targets: str) -> str:
    return f"""WITH c AS (SELECT protocol_hint, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q
    FROM flows GROUP BY 1), t AS ({targets}), r AS (SELECT source_row_index, protocol_hint, label,
      row_number() OVER (PARTITION BY protocol_hint, label ORDER BY {H}, source_row_index) AS rn FROM flows)
  SELECT r.source_row_index, r.protocol_hint, r.label FROM r JOIN t ON t.protocol_hint = r.protocol_hint
  WHERE r.rn <= CASE r.label WHEN 1 THEN take_pos ELSE take_neg END"""


# R-08
@query(targets_sql("""SELECT protocol_hint, CASE WHEN p + q <= 700 THEN p ELSE CAST(least(round_even(700::DOUBLE * p / (p + q), 0), p) AS BIGINT) END AS take_pos,
      CASE WHEN p + q <= 700 THEN q ELSE 700 - CAST(least(round_even(700::DOUBLE * p / (p + q), 0), p) AS BIGINT) END AS take_neg FROM c"""),
       ("flows",))
def stratified_subsample_proportional(spark, sf):
    out = sample.stratified_subsample(
        flows(spark, sf), by=["protocol_hint"], label="label", key=KEY, seed=SEED, max_rows=700
    )
    return out.select("source_row_index", "protocol_hint", "label")


# R-09
@query(targets_sql("""SELECT protocol_hint, CASE WHEN p + q <= 1500 THEN p ELSE least(p, 1500 - least(q, 1500)) END AS take_pos,
      CASE WHEN p + q <= 1500 THEN q ELSE least(q, 1500) END AS take_neg FROM c"""), ("flows",))
def subsample_keep_minority(spark, sf):
    out = sample.stratified_subsample(
        flows(spark, sf), by=["protocol_hint"], label="label", key=KEY, seed=SEED, max_rows=1500, policy="minority"
    )
    return out.select("source_row_index", "protocol_hint", "label")


# R-10
@query(f"""SELECT source_row_index, protocol_hint, label FROM flows
  QUALIFY row_number() OVER (PARTITION BY protocol_hint, label ORDER BY {H}, source_row_index)
    <= CASE label WHEN 1 THEN 120 ELSE 80 END""", ("flows",))
def sample_balanced(spark, sf):
    out = sample.sample_balanced(
        flows(spark, sf), by="protocol_hint", label="label", n_attack=120, n_benign=80, key=KEY, seed=SEED
    )
    return out.select("source_row_index", "protocol_hint", "label")


@query(f"""SELECT source_row_index, protocol_hint FROM flows
  QUALIFY row_number() OVER (PARTITION BY protocol_hint ORDER BY {H}, source_row_index) <= 200""", ("flows",))
def sample_per_protocol(spark, sf):
    out = sample.bottom_k_per_stratum(flows(spark, sf), strata=["protocol_hint"], k=200, key=KEY, seed=SEED)
    return out.select("source_row_index", "protocol_hint")


# W-21
@query(f"""SELECT source_row_index, protocol_hint, label FROM (SELECT *, abs(round(score - threshold, 9)) AS m FROM flows)
  QUALIFY row_number() OVER (PARTITION BY protocol_hint, label ORDER BY m, {H}, source_row_index) <= 150""", ("flows",))
def bottom_k_by_margin(spark, sf):
    f = flows(spark, sf).withColumn("m", F.abs(F.round(F.col("score") - F.col("threshold"), 9)))
    out = sample.bottom_k_per_stratum(f, strata=["protocol_hint", "label"], k=150, key=KEY, seed=SEED, by_value="m")
    return out.select("source_row_index", "protocol_hint", "label")


# R-11
@query("""SELECT source_relpath, label, count(*) AS pool, CAST(least(count(*), greatest(1, least(greatest(
    round_even(count(*) * 0.25::DOUBLE, 0), 3), 12))) AS BIGINT) AS target FROM line_flows GROUP BY 1, 2""", ("line_flows",))
def adaptive_target(spark, sf):
    pools = line_flows(spark, sf).groupBy("source_relpath", "label").agg(F.count("*").alias("pool"))
    t = sample.adaptive_target(F.col("pool"), F.lit(0.25), F.lit(3), F.lit(12))
    return pools.withColumn("target", t)


# R-12
BUCKETS = {
    (False, 0): {"fraction": 0.10, "min_rows": 6, "max_rows": 90},
    (False, 1): {"fraction": 0.05, "min_rows": 3, "max_rows": 40},
    (True, 0): {"fraction": 0.30, "min_rows": 8, "max_rows": 100},
    (True, 1): {"count": 50},
}


@query(f"""WITH s AS (SELECT source_row_index, protocol_hint, label, split = 'test' AS is_val FROM flows),
    p AS (SELECT protocol_hint, label, is_val, count(*) AS n FROM s GROUP BY 1, 2, 3),
    t AS (SELECT *, CASE WHEN is_val AND label = 1 THEN least(n, 50)
        WHEN is_val THEN least(n, greatest(1, least(greatest(round_even(n * 0.30::DOUBLE, 0), 8), 100)))
        WHEN label = 0 THEN least(n, greatest(1, least(greatest(round_even(n * 0.10::DOUBLE, 0), 6), 90)))
        ELSE least(n, greatest(1, least(greatest(round_even(n * 0.05::DOUBLE, 0), 3), 40))) END AS target FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY protocol_hint, is_val, label ORDER BY {H}, source_row_index) AS rn FROM s)
  SELECT r.source_row_index, r.protocol_hint, r.is_val, r.label FROM r JOIN t ON t.protocol_hint = r.protocol_hint
    AND t.label = r.label AND t.is_val = r.is_val WHERE rn <= target""", ("flows",))
def sample_by_bucket(spark, sf):
    f = flows(spark, sf).withColumn("is_val", F.col("split") == "test")
    out = sample.sample_by_bucket(
        f, by="protocol_hint", label="label", is_val="is_val", key=KEY, seed=SEED, buckets=BUCKETS
    )
    return out.select("source_row_index", "protocol_hint", "is_val", "label")


QUOTA = """c AS (SELECT protocol_hint, count(*) FILTER (WHERE label = 1) AS p0, count(*) FILTER (WHERE label = 0) AS q0
    FROM {src} GROUP BY 1), w(protocol_hint, t, ta) AS (VALUES ('wifi', 2000, 1800), ('mqtt', 2000, 1800), ('bluetooth', 2000, 1800)),
  d AS (SELECT w.protocol_hint, t, ta, t - ta AS tb, coalesce(p0, 0) AS p0, coalesce(q0, 0) AS q0,
      least(coalesce(p0, 0), t) AS p, least(coalesce(q0, 0), t) AS q FROM w LEFT JOIN c ON c.protocol_hint = w.protocol_hint),
  e AS (SELECT *, least(ta - least(p, ta), q - least(q, tb)) AS from_benign, least(tb - least(q, tb), p - least(p, ta))
      AS from_attack FROM d),
  plan AS (SELECT *, least(p, ta) + from_attack AS take_pos, least(q, tb) + from_benign AS take_neg FROM e)"""


# R-14, R-15: the plan
@query(f"""WITH {QUOTA.format(src="flows")} SELECT protocol_hint, CAST(t AS BIGINT) AS target_total, CAST(ta AS BIGINT) AS target_attack,
    CAST(tb AS BIGINT) AS target_benign, p0 AS available_attack, q0 AS available_benign, CAST(take_pos AS BIGINT) AS take_pos,
    CAST(take_neg AS BIGINT) AS take_neg, CAST(from_benign AS BIGINT) AS from_benign, CAST(from_attack AS BIGINT) AS from_attack
  FROM plan""", ("flows",))
def quota_plan(spark, sf):
    counts = sample.class_counts(flows(spark, sf), by=["protocol_hint"], label="label")
    return sample.quota_plan(
        counts, by="protocol_hint", targets=sample.protocol_targets(6000, PROTOCOLS), attack_ratio=0.9
    )


# R-15
@query(f"""WITH {QUOTA.format(src="flows")}, r AS (SELECT source_row_index, protocol_hint, label, row_number() OVER (
      PARTITION BY protocol_hint, label ORDER BY {H}, source_row_index) AS rn FROM flows)
  SELECT r.source_row_index, r.protocol_hint, r.label FROM r JOIN plan ON plan.protocol_hint = r.protocol_hint
  WHERE rn <= CASE label WHEN 1 THEN take_pos ELSE take_neg END""", ("flows",))
def quota_sample(spark, sf):
    out = sample.quota_sample(
        flows(spark, sf),
        by="protocol_hint",
        label="label",
        key=KEY,
        seed=SEED,
        total=6000,
        attack_ratio=0.9,
        protocols=PROTOCOLS,
    )
    return out.select("source_row_index", "protocol_hint", "label")


# R-16
SWEEP = {(p, y): (300 if y else 100) for p in PROTOCOLS for y in (0, 1)}


@query(f"""WITH s AS (SELECT source_row_index, protocol_hint, label, abs(round(score - threshold, 9)) AS m FROM flows),
    r AS (SELECT *, row_number() OVER (PARTITION BY protocol_hint, label ORDER BY m, {H}, source_row_index) AS a,
        row_number() OVER (PARTITION BY protocol_hint, label ORDER BY {H}, source_row_index) AS b FROM s)
  SELECT source_row_index, protocol_hint, label, CASE WHEN a <= CASE label WHEN 1 THEN 720 ELSE 576 END THEN 'dynamic'
      ELSE 'random' END AS pool FROM r
  WHERE a <= CASE label WHEN 1 THEN 720 ELSE 576 END OR b <= CASE label WHEN 1 THEN 280 ELSE 224 END""", ("flows",))
def score_sweep_pools(spark, sf):
    f = flows(spark, sf).withColumn("m", F.abs(F.round(F.col("score") - F.col("threshold"), 9)))
    out = sample.score_sweep_pools(
        f, by="protocol_hint", label="label", abs_margin="m", key=KEY, seed=SEED, targets=SWEEP
    )
    return out.select("source_row_index", "protocol_hint", "label", "pool")


# R-17
@query(f"""WITH n AS (SELECT CAST(floor(0.5 * count(*)) AS BIGINT) AS cap FROM flows WHERE protocol_hint = 'bluetooth' AND label = 0),
    r AS (SELECT source_row_index, protocol_hint, row_number() OVER (PARTITION BY protocol_hint ORDER BY {H}, source_row_index)
      AS rn FROM flows WHERE prediction = 1)
  SELECT source_row_index, protocol_hint FROM r, n WHERE protocol_hint <> 'bluetooth' OR rn <= cap""", ("flows",))
def cap_fraction(spark, sf):
    f = flows(spark, sf)
    pool = f.where((F.col("protocol_hint") == "bluetooth") & (F.col("label") == 0)).count()
    rows = f.where(F.col("prediction") == 1)
    out = sample.cap_fraction(
        rows, by="protocol_hint", group="bluetooth", pool_rows=pool, fraction=0.5, key=KEY, seed=SEED
    )
    return out.select("source_row_index", "protocol_hint")


# R-06 at volume: orders per priority
@query(f"""SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY {row_hash_sql("o_orderkey", seed=7)}, o_orderkey) <= 100""")
def sample_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sample.bottom_k_per_stratum(o, strata=["o_orderpriority"], k=100, key=["o_orderkey"], seed=7)


# A-29 style support: share of validation rows after the capture split
@query(f"""WITH {val_split_sql('capture')} SELECT protocol_hint, label, count(*) AS rows,
  round(avg(CAST(is_val AS DOUBLE)), 6) AS val_share FROM marked GROUP BY 1, 2""", ("flows",))
def val_share(spark, sf):
    out, _ = split.capture_val_split(
        coarse_captures(spark, sf), strata=["protocol_hint", "label"], capture="cap", row="source_row_index", seed=SEED
    )
    return rounded(
        out.groupBy("protocol_hint", "label").agg(
            F.count("*").alias("rows"), F.avg(F.col("is_val").cast("double")).alias("val_share")
        )
    )
