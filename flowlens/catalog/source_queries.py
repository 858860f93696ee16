"""Scans, paging, capture merging, table composition and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowlens.catalog.base import (
    THRESHOLDS,
    capture_rows,
    flows,
    line_flows,
    md5_bucket_sql,
    query,
    rounded,
    table,
)
from flowlens.functions.hashing import md5_bucket
from flowlens.operators import combine, profile, sample, score, split
from flowlens.plans.small import shared_dir
from flowlens.sources import readers, sinks


def scratch(spark, name):
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# S-01, S-02, S-04: captures with columns in other orders and more of them, found below a URI, merged, both sinks read back
@query("""WITH c AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'wifi/attacks/csv/train/a' WHEN 1 THEN 'wifi/attacks/csv/test/b'
      WHEN 2 THEN 'mqtt/profiling/csv/train/c' ELSE 'mqtt/attacks/csv/test/d' END AS capture FROM events)
  SELECT capture, CASE WHEN contains(capture, '/train/') THEN 'train' ELSE 'test' END AS sink,
    CAST(contains(capture, '/attacks/') AS INTEGER) AS label,
    count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(sum(user_id) AS BIGINT) AS users, round(sum(value), 4) AS total,
    count(*) * (count(*) + 1) // 2 AS row_numbers FROM c GROUP BY 1""")
def merge_written_captures(spark, sf):
    src = table(spark, sf, "events").select("event_id", "user_id", "value", F.lit("x").alias("note"))
    root = scratch(spark, "captures")
    uri = root if ":" in root else f"file:{root}"
    layouts = {
        "wifi/attacks/csv/train/a": ["event_id", "user_id", "value"],
        "wifi/attacks/csv/test/b": ["value", "note", "event_id", "user_id"],
        "mqtt/profiling/csv/train/c": ["user_id", "value", "event_id"],
        "mqtt/attacks/csv/test/d": ["event_id", "user_id", "value", "note"],
    }
    for i, (capture, columns) in enumerate(layouts.items()):
        part = src.where(F.col("event_id") % 4 == i).coalesce(1)  # a capture is one file
        sinks.write_table(part, f"{root}/{capture}", columns=columns, fmt="csv")
    found = readers.discover_captures(spark, uri)
    files = [r["uri"] for r in found.select("uri").collect()]  # a listing
    rows = readers.read_flows_csv(spark, files, schema=src.drop("note").schema, source="file")
    rows = rows.withColumn("source_relpath", readers.relative(F.col("file"), uri)).drop("file")
    merged = readers.merge_captures(rows, path="source_relpath", order=["event_id"])
    paths = sinks.write_splits(merged, scratch(spark, "merged"), split="assigned_split")
    both = [spark.read.parquet(p).withColumn("sink", F.lit(s)) for s, p in paths.items()]
    capture = F.regexp_replace("source_relpath", "/[^/]*$", "").alias("capture")
    return both[0].unionByName(both[1]).groupBy(capture, "sink", "label").agg(
        F.count("*").alias("n"),
        F.sum("event_id").alias("ids"),
        F.sum("user_id").alias("users"),
        F.round(F.sum("value"), 4).alias("total"),
        F.sum("source_row_index").cast("long").alias("row_numbers"),
    )


# S-01
@query("""SELECT DISTINCT source_relpath FROM capture_rows
  WHERE (list_contains(string_split(lower(source_relpath), '/'), 'attacks')
      OR list_contains(string_split(lower(source_relpath), '/'), 'profiling'))
    AND list_contains(string_split(lower(source_relpath), '/'), 'csv') AND lower(source_relpath) LIKE '%.csv'""",
  ("capture_rows",))
def discover_captures(spark, sf):
    return readers.filter_captures(capture_rows(spark, sf), path="source_relpath").select("source_relpath").distinct()


# S-02
@query("SELECT event_id, user_id, event_type, value FROM events")
def read_flows_csv(spark, sf):
    """Write the events as header CSV to the shared folder and read them back with a declared schema."""
    src = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    root = scratch(spark, "csv")
    sinks.write_table(src, root, fmt="csv")
    schema = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").schema
    return readers.read_flows_csv(spark, root, schema=schema)


# S-03, S-06
@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1""")
def read_flows_parquet(spark, sf):
    df = readers.read_flows_parquet(spark, f"{sf}/lineitem.parquet", columns=["l_returnflag", "l_quantity"])
    return rounded(df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean_quantity")))


# S-06
@query("SELECT source_relpath, protocol_hint, label, score FROM flows UNION ALL SELECT source_relpath, protocol_hint, label, score FROM line_flows",
       ("flows", "line_flows"))
def project_scan(spark, sf):
    left, right = flows(spark, sf), line_flows(spark, sf)
    both = ["source_relpath", "protocol_hint", "label", "score"]
    cols = [c for c in readers.common_columns(left, right) if c in both]
    return readers.project_scan(left, cols).unionByName(readers.project_scan(right, cols))


# S-04
@query(f"""WITH n AS (SELECT event_id, source_relpath,
      row_number() OVER (PARTITION BY source_relpath ORDER BY event_id) AS source_row_index FROM capture_rows)
  SELECT event_id, source_relpath, source_row_index,
    CASE WHEN contains(source_relpath, '/train/') THEN 'train' WHEN contains(source_relpath, '/test/') THEN 'test'
      WHEN {md5_bucket_sql("source_relpath")} < 20 THEN 'test' ELSE 'train' END AS assigned_split,
    CAST(contains(source_relpath, '/attacks/') AND NOT contains(lower(source_relpath), 'benign') AS INTEGER) AS label FROM n""",
  ("capture_rows",))
def merge_captures(spark, sf):
    m = readers.merge_captures(capture_rows(spark, sf), path="source_relpath", order=["event_id"])
    return m.select("event_id", "source_relpath", "source_row_index", "assigned_split", "label")


# S-05
@query("""SELECT split, count(DISTINCT source_relpath) AS files, count(*) AS rows_total,
    count(*) FILTER (WHERE label = 1) AS attack_rows, count(*) FILTER (WHERE label = 0) AS benign_rows
  FROM flows GROUP BY split""", ("flows",))
def merge_stats(spark, sf):
    return readers.merge_stats(flows(spark, sf), capture="source_relpath", split="split", is_attack="label")


# S-08
@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 500")
def limit_scan(spark, sf):
    return readers.limit_scan(table(spark, sf, "events").select("event_id", "value"), order=["event_id"], n=500)


# S-09
@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 50 OFFSET 100")
def read_window(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return readers.read_window(df, order=["event_id"], start=100, n=50)


# S-10
@query("""SELECT 'orders' AS kind, o_orderstatus AS code, CAST(NULL AS DOUBLE) AS discount, count(*) AS n FROM orders GROUP BY 2
  UNION ALL SELECT 'lineitem', l_returnflag, round(avg(l_discount), 6), count(*) FROM lineitem GROUP BY 2""")
def write_dynamic_table(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("code")).agg(
        F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("discount")
    )
    out = sinks.dynamic_table([a.withColumn("kind", F.lit("orders")), b.withColumn("kind", F.lit("lineitem"))])
    path = scratch(spark, "table")
    sinks.write_table(out, path, partition_by=("kind",))
    return spark.read.parquet(path).select(*out.columns)


# S-11
@query("""SELECT protocol_hint, concat('{"protocol_hint":"', protocol_hint, '","n":', CAST(count(*) AS VARCHAR), ',"ratio":null}')
    AS report FROM flows GROUP BY 1""", ("flows",))
def write_json_report(spark, sf):
    g = flows(spark, sf).groupBy("protocol_hint").agg(F.count("*").alias("n"))
    g = g.withColumn("ratio", F.lit(float("nan")))
    path = scratch(spark, "report")
    sinks.write_json_report(g, path)
    js = spark.read.text(path)
    return js.select(F.get_json_object("value", "$.protocol_hint").alias("protocol_hint"), F.col("value").alias("report"))


# S-13
@query("""SELECT source_row_index, score FROM flows WHERE split = 'test'""", ("flows",))
def materialize_replay(spark, sf):
    params = {"sf": sf, "split": "test", "columns": ["source_row_index", "score"]}
    build = lambda: flows(spark, sf).where(F.col("split") == "test").select(*params["columns"])
    return sinks.materialize_replay(spark, build, shared_dir(spark), params, [f"{sf}/events.parquet"])


# S-14
@query("SELECT source_row_index, score FROM flows ORDER BY score DESC, source_row_index LIMIT 2000", ("flows",))
def preview(spark, sf):
    df = flows(spark, sf).select("source_row_index", "score")
    return readers.preview(df, order=[F.col("score").desc(), "source_row_index"])


# J-01
@query("""SELECT source_row_index, coalesce(t.thr, 0.5) AS threshold,
    CAST(score >= coalesce(t.thr, 0.5) AS INTEGER) AS prediction
  FROM flows f LEFT JOIN (VALUES ('wifi', 0.55::DOUBLE), ('bluetooth', 0.6::DOUBLE)) t(p, thr) ON f.protocol_hint = t.p""",
  ("flows",))
def threshold_lookup(spark, sf):
    thr = spark.createDataFrame(
        [(p, t) for p, t in THRESHOLDS.items() if p != "mqtt"], "protocol_hint string, threshold double"
    )
    f = flows(spark, sf).select("source_row_index", "protocol_hint", "score")
    out = score.threshold_lookup(f, thr, on="protocol_hint")
    return out.select("source_row_index", "threshold", (F.col("score") >= F.col("threshold")).cast("int").alias("prediction"))


# J-03
@query("""SELECT a.attack_family, a.n, coalesce(b.mean_score, 0) AS mean_score FROM
    (SELECT attack_family, count(*) AS n FROM flows GROUP BY 1) a LEFT JOIN
    (SELECT attack_family, round(avg(score), 6) AS mean_score FROM flows WHERE protocol_hint = 'wifi' GROUP BY 1) b
    USING (attack_family)""", ("flows",))
def merge_fill(spark, sf):
    f = flows(spark, sf)
    a = f.groupBy("attack_family").agg(F.count("*").alias("n"))
    b = f.where(F.col("protocol_hint") == "wifi").groupBy("attack_family").agg(F.round(F.avg("score"), 6).alias("mean_score"))
    return combine.merge_fill(a, b, on=["attack_family"], fill={"mean_score": 0.0})


def external(spark, sf):
    """Rows offered for admission: every event again, those with k below 50 under new row numbers."""
    shifted = F.when(F.col("k") < 50, F.col("source_row_index") + 100000000).otherwise(F.col("source_row_index"))
    return flows(spark, sf).select(
        "source_relpath", shifted.alias("source_row_index"), "protocol_hint", "label", "value"
    )


EXTERNAL = """ext AS (SELECT source_relpath, CASE WHEN k < 50 THEN source_row_index + 100000000 ELSE source_row_index END
  AS source_row_index, protocol_hint, label, value FROM flows)"""
KEY = ["source_relpath", "source_row_index"]


# J-04
@query(f"""WITH {EXTERNAL} SELECT e.* FROM ext e WHERE NOT EXISTS (SELECT 1 FROM flows f
    WHERE f.source_relpath = e.source_relpath AND f.source_row_index = e.source_row_index)""", ("flows",))
def drop_overlap(spark, sf):
    return combine.drop_overlap(external(spark, sf), flows(spark, sf), key=KEY)


# R-18
@query(f"""WITH {EXTERNAL} SELECT source_relpath, source_row_index, protocol_hint, label, value FROM flows
  UNION ALL SELECT e.* FROM ext e WHERE label = 0 AND protocol_hint IN ('wifi', 'mqtt') AND NOT EXISTS (SELECT 1 FROM flows f
    WHERE f.source_relpath = e.source_relpath AND f.source_row_index = e.source_row_index)""", ("flows",))
def external_benign_append(spark, sf):
    base = flows(spark, sf).select(*KEY, "protocol_hint", "label", "value")
    extra = sample.external_benign(
        base, external(spark, sf), key=KEY, by="protocol_hint", label="label", protocols=["wifi", "mqtt"]
    )
    return base.unionByName(extra)


# A-40
@query(f"""WITH {EXTERNAL}, j AS (SELECT e.*, e.label = 0 AND e.protocol_hint IN ('wifi', 'mqtt') AS ok,
      EXISTS (SELECT 1 FROM flows f WHERE f.source_relpath = e.source_relpath AND f.source_row_index = e.source_row_index)
      AS hit FROM ext e)
  SELECT count(*) AS rows_raw, count(*) FILTER (WHERE NOT ok) AS dropped_basic,
    count(*) FILTER (WHERE ok AND hit) AS dropped_overlap, count(*) FILTER (WHERE ok AND NOT hit) AS rows_kept FROM j""",
  ("flows",))
def admission_summary(spark, sf):
    return sample.admission_summary(
        flows(spark, sf), external(spark, sf), key=KEY, by="protocol_hint", label="label", protocols=["wifi", "mqtt"]
    )


# J-05, R-05
@query("""WITH s AS (SELECT source_relpath FROM flows WHERE split = 'test'
      INTERSECT SELECT source_relpath FROM flows WHERE label = 1)
  SELECT count(*) AS overlap, (SELECT string_agg(source_relpath, ',' ORDER BY source_relpath) FROM
      (SELECT source_relpath FROM s ORDER BY 1 LIMIT 10)) AS first_captures, count(*) = 0 AS disjoint FROM s""",
  ("flows",))
def capture_overlap(spark, sf):
    """Test captures that also hold attack rows: a leak on purpose, so the report has something to show."""
    f = flows(spark, sf)
    return split.capture_overlap(
        f.where(F.col("split") == "test"), f.where(F.col("label") == 1), capture="source_relpath"
    )


# U-04, R-05: the real check
@query("""SELECT count(*) AS overlap FROM (SELECT source_relpath FROM flows WHERE split = 'train'
    INTERSECT SELECT source_relpath FROM flows WHERE split = 'test')""", ("flows",))
def capture_disjoint_check(spark, sf):
    f = flows(spark, sf)
    shared = split.shared_captures(
        f.where(F.col("split") == "train"), f.where(F.col("split") == "test"), capture="source_relpath"
    )
    return shared.agg(F.count("*").alias("overlap"))


# J-10
@query("""WITH m AS (SELECT protocol_hint, round(avg(score), 6) AS t FROM flows WHERE protocol_hint <> 'bluetooth' GROUP BY 1),
    p AS (SELECT DISTINCT protocol_hint FROM flows)
  SELECT p.protocol_hint, CASE p.protocol_hint WHEN 'wifi' THEN 0.7::DOUBLE ELSE coalesce(m.t, 0.5) END AS threshold,
    CASE WHEN p.protocol_hint = 'wifi' THEN 'custom' WHEN m.t IS NOT NULL THEN 'metrics' ELSE 'default' END AS origin
  FROM p LEFT JOIN m USING (protocol_hint)""", ("flows",))
def resolve_thresholds(spark, sf):
    f = flows(spark, sf)
    kind = "protocol_hint string, threshold double"
    custom = spark.createDataFrame([("wifi", 0.7)], kind)
    file = spark.createDataFrame([("mqtt", float("inf")), ("wifi", 0.2)], kind)
    metrics = (
        f.where(F.col("protocol_hint") != "bluetooth")
        .groupBy("protocol_hint")
        .agg(F.round(F.avg("score"), 6).alias("threshold"))
    )
    return score.resolve_thresholds(f, custom, file, metrics, on="protocol_hint")


# J-12
@query("""SELECT source_row_index, label, CASE WHEN protocol_hint <> 'mqtt' THEN prediction END AS prediction FROM flows""",
       ("flows",))
def attach_predictions(spark, sf):
    f = flows(spark, sf)
    predictions = f.where(F.col("protocol_hint") != "mqtt").select("source_row_index", "prediction")
    return combine.attach_predictions(f.select("source_row_index", "label"), predictions, key=["source_row_index"])


# U-01
@query("""SELECT kind, count(*) AS n FROM (SELECT 'event' AS kind FROM events UNION ALL SELECT 'line' FROM lineitem
    UNION ALL SELECT 'order' FROM orders) GROUP BY kind""")
def union_all(spark, sf):
    frames = [
        table(spark, sf, t).select(F.lit(k).alias("kind"))
        for k, t in (("event", "events"), ("line", "lineitem"), ("order", "orders"))
    ]
    return combine.union_all(frames).groupBy("kind").agg(F.count("*").alias("n"))


# U-02, U-03
@query("""SELECT source_relpath, max(CASE WHEN a = 1 THEN source_row_index END) AS first_row,
    max(CASE WHEN b = 1 THEN source_row_index END) AS last_row
  FROM (SELECT *, row_number() OVER (PARTITION BY source_relpath ORDER BY score, source_row_index) AS a,
          row_number() OVER (PARTITION BY source_relpath ORDER BY score DESC, source_row_index DESC) AS b FROM flows)
  GROUP BY 1""", ("flows",))
def distinct_keep(spark, sf):
    f = flows(spark, sf).select("source_relpath", "source_row_index", "score")
    order = [F.col("score"), F.col("source_row_index")]
    first = combine.distinct_keep(f, key=["source_relpath"], order=order)
    last = combine.distinct_keep(f, key=["source_relpath"], order=order, last=True)
    return first.select("source_relpath", F.col("source_row_index").alias("first_row")).join(
        last.select("source_relpath", F.col("source_row_index").alias("last_row")), "source_relpath"
    )


# U-05
@query("""SELECT source_row_index FROM flows EXCEPT SELECT source_row_index FROM flows WHERE prediction = 1""", ("flows",))
def select_not_in(spark, sf):
    f = flows(spark, sf)
    chosen = f.where(F.col("prediction") == 1)
    return combine.select_not_in(f.select("source_row_index"), chosen, key=["source_row_index"])


# U-07
@query("""SELECT label, origin, weight, count(*) AS n FROM (
    SELECT label, 'base' AS origin, 1::DOUBLE AS weight FROM flows
    UNION ALL SELECT 0, 'hard_negative', 3::DOUBLE FROM flows WHERE label = 0 AND prediction = 1
    UNION ALL SELECT 1, 'adversarial', 2::DOUBLE FROM flows WHERE label = 1 AND prediction = 0) GROUP BY ALL""", ("flows",))
def weighted_union(spark, sf):
    f = flows(spark, sf).select("source_row_index", "label", "prediction")
    out = combine.weighted_union(
        f,
        f.where((F.col("label") == 0) & (F.col("prediction") == 1)),
        f.where((F.col("label") == 1) & (F.col("prediction") == 0)),
        label="label",
        w_benign=3.0,
        w_attack=2.0,
    )
    return out.groupBy("label", "origin", "weight").agg(F.count("*").alias("n"))


# O-01, O-03
@query("""SELECT source_row_index, score, r FROM (SELECT *, CASE WHEN hr > 0 THEN k / hr END AS r FROM flows)
  ORDER BY r DESC NULLS LAST, score ASC, source_row_index LIMIT 25""", ("flows",))
def sort_mixed_top(spark, sf):
    r = F.when(F.col("hr") > 0, F.col("k") / F.col("hr")).otherwise(F.lit(float("nan")))
    f = flows(spark, sf).select("source_row_index", "score", r.alias("r"))
    return combine.sort_by(f, order=[("r", False), ("score", True), ("source_row_index", True)], n=25)


# O-02
@query("""SELECT source_row_index, round(score - threshold, 6) AS margin FROM flows
  ORDER BY abs(round(score - threshold, 6)) DESC, source_row_index LIMIT 20""", ("flows",))
def sort_by_abs(spark, sf):
    f = flows(spark, sf).select("source_row_index", F.round(F.col("score") - F.col("threshold"), 6).alias("margin"))
    return combine.sort_by_abs(f, col="margin", tie=["source_row_index"], n=20)


# P-21
@query("""SELECT split, protocol_hint, count(*) AS rows, round(avg(label), 6) AS attack_ratio FROM flows GROUP BY 1, 2""",
       ("flows",))
def dataset_sizes(spark, sf):
    return rounded(profile.table_sizes(flows(spark, sf), by=["split", "protocol_hint"], label="label"))


# F-01 at volume
@query(f"""SELECT {md5_bucket_sql("CAST(l_orderkey AS VARCHAR)", 10)} AS bucket, count(*) AS n FROM lineitem GROUP BY 1""")
def hash_bucket_counts(spark, sf):
    b = md5_bucket(F.col("l_orderkey").cast("string"), 10)
    return table(spark, sf, "lineitem").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
