"""Coercions, path metadata, scalar functions and row filters over the event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.catalog.base import (
    MODELS,
    capture_rows,
    flows,
    md5_bucket_sql,
    query,
    rounded,
    row_hash_sql,
    table,
)
from flowlens.functions import coerce, hashing, numeric, paths
from flowlens.operators import combine, replay
from flowlens.operators.score import linear_score_column


def messy(spark, sf) -> DataFrame:
    """A text column with every kind of bad number, cycling with k."""
    r = F.pmod(F.col("k").cast("int"), F.lit(10))
    cases = {0: "nan", 1: "inf", 2: "", 3: "abc", 5: " 7.5 ", 6: "-3", 7: "1e3", 9: "2"}
    text: Column = F.when(r == 4, F.lit(None).cast("string"))
    for n, t in cases.items():
        text = text.when(r == n, F.lit(t))
    return flows(spark, sf).select(
        "source_row_index", "value", "k", text.otherwise(F.col("value").cast("string")).alias("txt")
    )


MESSY = """messy AS (SELECT source_row_index, value, k, CASE CAST(k AS INTEGER) % 10 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf'
  WHEN 2 THEN '' WHEN 3 THEN 'abc' WHEN 4 THEN NULL WHEN 5 THEN ' 7.5 ' WHEN 6 THEN '-3' WHEN 7 THEN '1e3'
  WHEN 9 THEN '2' ELSE CAST(value AS VARCHAR) END AS txt FROM flows)"""
NUM = "TRY_CAST(trim(txt) AS DOUBLE)"


# P-01
@query(f"""WITH {MESSY} SELECT source_row_index,
  CASE WHEN {NUM} IS NULL OR isnan({NUM}) OR isinf({NUM}) THEN 0::DOUBLE ELSE {NUM} END AS v FROM messy""", ("flows",))
def safe_float_zero(spark, sf):
    return messy(spark, sf).select("source_row_index", coerce.safe_float_zero("txt").alias("v"))


# P-02
@query(f"""WITH {MESSY} SELECT source_row_index, coalesce(isnan({NUM}), false) AS is_nan_text,
  CASE WHEN {NUM} IS NULL OR isnan({NUM}) OR isinf({NUM}) THEN 0::DOUBLE ELSE {NUM} END AS v, {NUM} IS NULL AS is_missing
  FROM messy""", ("flows",))
def safe_float_missing(spark, sf):
    s = coerce.safe_float_missing("txt")
    return messy(spark, sf).select(
        "source_row_index",
        F.isnan(s["value"]).alias("is_nan_text"),
        coerce.scalar_sanitize(s["value"]).alias("v"),
        s["is_missing"].alias("is_missing"),
    )


# P-03
@query(f"""WITH {MESSY} SELECT source_row_index, coalesce(isinf({NUM}), false) AS kept_inf,
  CASE WHEN {NUM} IS NULL OR isnan({NUM}) OR isinf({NUM}) THEN 0::DOUBLE ELSE {NUM} END AS finite_txt, 0::DOUBLE AS absent
  FROM messy""", ("flows",))
def coerce_features(spark, sf):
    df = coerce.coerce_features(messy(spark, sf), ["txt", "absent"])
    return df.select(
        "source_row_index",
        (F.abs("txt") == float("inf")).alias("kept_inf"),
        coerce.scalar_sanitize("txt").alias("finite_txt"),
        "absent",
    )


# P-04
@query(f"""WITH {MESSY} SELECT source_row_index,
  coalesce(CASE WHEN isnan({NUM}) OR isinf({NUM}) THEN NULL ELSE CAST(trunc({NUM}) AS BIGINT) END, -1) AS v FROM messy""",
  ("flows",))
def maybe_int(spark, sf):
    return messy(spark, sf).select("source_row_index", coerce.maybe_int("txt", -1).alias("v"))


# P-05, P-06
@query(f"""WITH {MESSY}, i AS (SELECT source_row_index,
  coalesce(CASE WHEN isnan({NUM}) OR isinf({NUM}) THEN NULL ELSE CAST(trunc({NUM}) AS BIGINT) END, 0) AS v FROM messy)
  SELECT source_row_index, CAST(least(greatest(v, 0), 1) AS INTEGER) AS clipped,
    CASE WHEN v = 1 THEN 1 ELSE 0 END AS eq_one FROM i""", ("flows",))
def normalize_labels(spark, sf):
    return messy(spark, sf).select(
        "source_row_index", coerce.normalize_label("txt").alias("clipped"), coerce.label_eq_one("txt").alias("eq_one")
    )


# P-07, P-08, P-09
@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('  Wi-Fi ', event_type, '! ')
    WHEN 1 THEN '   ' WHEN 2 THEN upper(event_type) END AS raw FROM events)
  SELECT event_id, coalesce(nullif(trim(regexp_replace(lower(trim(raw)), '[^\\p{L}\\p{N}]', '_', 'g'), '_'), ''), 'unknown')
    AS slug, coalesce(nullif(trim(raw), ''), 'unknown') AS filled,
    regexp_replace(lower(raw), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM t""")
def text_slugs(spark, sf):
    r = F.pmod("event_id", F.lit(4))
    raw = (
        F.when(r == 0, F.concat(F.lit("  Wi-Fi "), F.col("event_type"), F.lit("! ")))
        .when(r == 1, F.lit("   "))
        .when(r == 2, F.upper("event_type"))
    )
    t = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return t.select(
        "event_id",
        coerce.protocol_slug("raw").alias("slug"),
        coerce.default_string("raw").alias("filled"),
        coerce.feature_name_key("raw").alias("key"),
    )


CORE = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(source_relpath, '[^/]*$'), '\\.csv$', '', 'i'), '\\.pcap$', '', 'i'), '_(train|test)$', '', 'i')"


# P-10, P-11
@query(f"""SELECT DISTINCT source_relpath, regexp_extract(source_relpath, '[^/]*$') AS file_name, {CORE} AS core,
  CASE WHEN list_contains(string_split(lower(source_relpath), '/'), 'train') THEN 'train'
       WHEN list_contains(string_split(lower(source_relpath), '/'), 'test') THEN 'test' ELSE 'unspecified' END AS folder
  FROM capture_rows""", ("capture_rows",))
def path_names(spark, sf):
    p = capture_rows(spark, sf).select("source_relpath").distinct()
    name = paths.file_name("source_relpath")
    return p.select(
        "source_relpath",
        name.alias("file_name"),
        paths.trim_split_suffix(paths.strip_extensions(name)).alias("core"),
        paths.split_folder("source_relpath").alias("folder"),
    )


# P-12
@query(f"""WITH p AS (SELECT DISTINCT source_relpath, {CORE} AS core, string_split(lower(source_relpath), '/') AS parts
    FROM capture_rows), q AS (SELECT *, CASE WHEN contains(parts[1], 'bluetooth') THEN 'bluetooth'
      WHEN contains(parts[1], 'wifi') OR contains(parts[1], 'mqtt') THEN 'wifi_mqtt'
      ELSE string_split(source_relpath, '/')[1] END AS modality FROM p)
  SELECT source_relpath, modality, CASE WHEN list_contains(parts, 'attacks') THEN 'attacks'
      WHEN list_contains(parts, 'profiling') THEN 'profiling' ELSE 'other' END AS grp,
    CASE WHEN modality = 'bluetooth' THEN 'bluetooth'
      WHEN contains(lower(core), 'mqtt') OR contains(lower(core), 'broker') THEN 'mqtt'
      WHEN modality = 'wifi_mqtt' THEN 'wifi' ELSE 'unknown' END AS hint FROM q""", ("capture_rows",))
def path_protocols(spark, sf):
    p = paths.with_path_metadata(capture_rows(spark, sf).select("source_relpath").distinct())
    return p.select(
        "source_relpath",
        F.col("source_modality").alias("modality"),
        F.col("source_group").alias("grp"),
        F.col("protocol_hint").alias("hint"),
    )


FAMILY = """CASE WHEN core LIKE 'TCP\\_IP-DDoS-%' ESCAPE '\\' OR core LIKE 'MQTT-DDoS-%' THEN 'DDoS'
  WHEN core LIKE 'TCP\\_IP-DoS-%' ESCAPE '\\' OR core LIKE 'MQTT-DoS-%' THEN 'DoS' WHEN core LIKE 'Recon-%' THEN 'Recon'
  WHEN contains(lower(core), 'spoof') THEN 'Spoofing' WHEN contains(core, 'Malformed') THEN 'Malformed'
  WHEN contains(lower(core), 'benign') THEN 'Benign' ELSE 'Other' END"""


# P-13
@query(f"""WITH p AS (SELECT DISTINCT source_relpath, {CORE} AS core FROM capture_rows)
  SELECT source_relpath, {FAMILY} AS family,
    regexp_replace(core, '^(TCP_IP-DDoS-|TCP_IP-DoS-|MQTT-DDoS-|MQTT-DoS-|Recon-)', '') AS variant FROM p""",
  ("capture_rows",))
def attack_families(spark, sf):
    p = capture_rows(spark, sf).select("source_relpath").distinct()
    core = paths.trim_split_suffix(paths.strip_extensions(paths.file_name("source_relpath")))
    fam = paths.attack_family(core)
    return p.select("source_relpath", fam["family"].alias("family"), fam["variant"].alias("variant"))


# P-14
@query(f"""WITH p AS (SELECT DISTINCT source_relpath, {CORE} AS core FROM capture_rows)
  SELECT source_relpath, CASE WHEN core IN ('Active', 'Idle', 'ActiveBroker') THEN core
      WHEN contains(core, '_LAN_') THEN split_part(core, '_LAN_', 1) WHEN contains(core, '_WAN_') THEN split_part(core, '_WAN_', 1)
      WHEN core LIKE '%\\_Power' ESCAPE '\\' THEN left(core, length(core) - 6) ELSE core END AS device,
    CASE WHEN core IN ('Active', 'Idle', 'ActiveBroker') THEN core
      WHEN contains(core, '_LAN_') THEN concat('LAN_', substr(core, strpos(core, '_LAN_') + 5))
      WHEN contains(core, '_WAN_') THEN concat('WAN_', substr(core, strpos(core, '_WAN_') + 5))
      WHEN core LIKE '%\\_Power' ESCAPE '\\' THEN 'Power' ELSE 'Profiling' END AS scenario
  FROM p WHERE contains(source_relpath, '/profiling/')""", ("capture_rows",))
def device_scenarios(spark, sf):
    p = capture_rows(spark, sf).select("source_relpath").distinct()
    p = p.where(paths.source_group("source_relpath") == "profiling")
    core = paths.trim_split_suffix(paths.strip_extensions(paths.file_name("source_relpath")))
    ds = paths.device_scenario(core)
    return p.select("source_relpath", ds["device"].alias("device"), ds["scenario"].alias("scenario"))


# P-15
@query(f"""WITH p AS (SELECT DISTINCT source_relpath, {CORE} AS core FROM capture_rows), q AS (SELECT *,
    CAST(contains(source_relpath, '/attacks/') AND NOT contains(lower(core), 'benign') AS INTEGER) AS is_attack FROM p)
  SELECT source_relpath, is_attack, 1 - is_attack AS is_benign, is_attack AS label,
    CASE WHEN contains(source_relpath, '/attacks/') THEN core ELSE 'Benign' END AS attack_name FROM q""",
  ("capture_rows",))
def path_labels(spark, sf):
    p = paths.with_path_metadata(capture_rows(spark, sf).select("source_relpath").distinct())
    return p.select("source_relpath", "is_attack", "is_benign", "label", "attack_name")


# P-16
@query(f"""WITH p AS (SELECT DISTINCT source_relpath, string_split(lower(source_relpath), '/') AS parts FROM capture_rows)
  SELECT source_relpath, CASE WHEN list_contains(parts, 'train') THEN 'train' WHEN list_contains(parts, 'test') THEN 'test'
      WHEN {md5_bucket_sql("source_relpath")} < 20 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN list_contains(parts, 'train') OR list_contains(parts, 'test') THEN 'folder' ELSE 'profile_hash_20' END
      AS strategy FROM p""", ("capture_rows",))
def assign_split(spark, sf):
    p = capture_rows(spark, sf).select("source_relpath").distinct()
    s = paths.assign_split("source_relpath", 20)
    return p.select("source_relpath", s["split"].alias("split"), s["strategy"].alias("strategy"))


# P-17, P-18, P-19
@query("""SELECT source_row_index, CASE WHEN label = 1 AND prediction = 1 THEN 'TP' WHEN label = 0 AND prediction = 0
    THEN 'TN' WHEN label = 0 THEN 'FP' ELSE 'FN' END AS outcome, round(score - threshold, 6) AS margin,
    round(abs(score - threshold), 6) AS abs_margin,
    CASE WHEN prediction = 1 THEN 'attack' ELSE 'benign' END AS prediction_label,
    CASE WHEN value - k >= 0 THEN 'attack' ELSE 'benign' END AS direction FROM flows""", ("flows",))
def row_outcomes(spark, sf):
    f = flows(spark, sf)
    m = coerce.margin("score", "threshold")
    return f.select(
        "source_row_index",
        coerce.classify_outcome("label", "prediction").alias("outcome"),
        F.round(m, 6).alias("margin"),
        F.round(F.abs(m), 6).alias("abs_margin"),
        coerce.prediction_label("prediction").alias("prediction_label"),
        coerce.direction(F.col("value") - F.col("k")).alias("direction"),
    )


# P-20
@query("""SELECT source_row_index, CASE WHEN k > 0 THEN round(value / k, 9) ELSE 0 END AS clean FROM flows""", ("flows",))
def scalar_sanitize(spark, sf):
    q = F.when(F.col("k") > 0, F.col("value") / F.col("k")).otherwise(F.lit(float("nan")))
    return flows(spark, sf).select("source_row_index", F.round(coerce.scalar_sanitize(q), 9).alias("clean"))


# F-01, F-02
@query(f"""SELECT event_id, {md5_bucket_sql("CAST(event_id AS VARCHAR)")} AS bucket100,
  {md5_bucket_sql("props", 7)} AS bucket7, {row_hash_sql("user_id", "event_id", seed=42)} AS row_hash FROM events""")
def stable_hashes(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        hashing.md5_bucket(F.col("event_id").cast("string"), 100).alias("bucket100"),
        hashing.md5_bucket("props", 7).alias("bucket7"),
        hashing.row_hash("user_id", "event_id", seed=42).alias("row_hash"),
    )


# F-04, F-05
@query("""SELECT source_row_index, round(1 / (1 + exp(-((value - 50) / 10))), 6) AS sig,
  round(1 / (1 + exp(-least(greatest(value - 50, -40), 40))), 6) AS stable_sig,
  round(1 / (1 + exp(-(0.03::DOUBLE * value + 0.05::DOUBLE * k + 0.01::DOUBLE * hr - 3.7::DOUBLE))), 6) AS linear
  FROM flows""", ("flows",))
def sigmoid_scores(spark, sf):
    v = F.col("value") - F.lit(50.0)
    m = MODELS["wifi"]
    return flows(spark, sf).select(
        "source_row_index",
        F.round(numeric.sigmoid(v / F.lit(10.0)), 6).alias("sig"),
        F.round(numeric.stable_sigmoid(v), 6).alias("stable_sig"),
        F.round(linear_score_column(m.weights, m.bias), 6).alias("linear"),
    )


# F-06
@query("""SELECT source_row_index, least(greatest(value, 10), 80) AS clipped,
  round(exp(ln(0.001::DOUBLE) + k / 100 * (ln(0.1::DOUBLE) - ln(0.001::DOUBLE))), 6) AS log_uniform,
  round(value + 3 * ((value + k - value) / 4), 6) AS grid_3 FROM flows""", ("flows",))
def clip_and_grids(spark, sf):
    g = numeric.linspace(F.col("value"), F.col("value") + F.col("k"), 5)
    return flows(spark, sf).select(
        "source_row_index",
        numeric.clip("value", 10.0, 80.0).alias("clipped"),
        F.round(numeric.log_uniform("k_score", 0.001, 0.1), 6).alias("log_uniform"),
        F.round(F.get(g, F.lit(3)), 6).alias("grid_3"),
    )


# F-07
@query("""SELECT doc_id, lower(trim(source)) AS low, starts_with(source, 'a') AS starts_a, contains(text, 'the') AS has_the,
  CAST(length(replace(text, ' ', '')) AS BIGINT) AS solid_chars, printf('%s_%05d', lang, doc_id) AS padded
  FROM documents""")
def string_functions(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        F.lower(F.trim("source")).alias("low"),
        F.col("source").startswith("a").alias("starts_a"),
        F.col("text").contains("the").alias("has_the"),
        F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("bigint").alias("solid_chars"),
        F.format_string("%s_%05d", F.col("lang"), F.col("doc_id")).alias("padded"),
    )


# F-08
@query("""SELECT vec_id, round(list_sum([x * x for x in v]), 4) AS self_dot,
  round(sqrt(list_sum([x * x for x in v])), 4) AS l2, round(list_max([abs(x) for x in v]), 6) AS linf,
  len([x for x in v if abs(x) > 0.1]) AS above, round(list_sort(v)[1], 6) AS smallest
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""")
def array_functions(spark, sf):
    v = F.col("embedding").cast("array<double>")
    df = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return df.select(
        "vec_id",
        F.round(numeric.dot("v", "v"), 4).alias("self_dot"),
        F.round(numeric.l2_norm("v"), 4).alias("l2"),
        F.round(numeric.max_abs("v"), 6).alias("linf"),
        numeric.count_above("v", 0.1).cast("bigint").alias("above"),
        F.round(F.get(F.array_sort("v"), F.lit(0)), 6).alias("smallest"),
    )


# F-09
@query("""SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  concat('{"user":', CAST(user_id AS VARCHAR), ',"kind":"', event_type, '"}') AS js, count(*) AS n FROM events GROUP BY ALL""")
def json_functions(spark, sf):
    js = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")))
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").groupBy("user_id", k.alias("k"), js.alias("js")).agg(F.count("*").alias("n"))


# F-10
@query("""SELECT user_id, round(hi / nullif(lo, 0)::DOUBLE, 6) AS r_null, round(coalesce(hi / nullif(lo, 0)::DOUBLE, 0), 6)
    AS r_zero, round(hi / greatest(lo, 1)::DOUBLE, 6) AS r_max1
  FROM (SELECT user_id, count(*) FILTER (WHERE value >= 50) AS hi, count(*) FILTER (WHERE value < 0.5) AS lo FROM events
        GROUP BY user_id)""")
def ratio_policies(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.when(F.col("value") >= 50, 1)).alias("hi"), F.count(F.when(F.col("value") < 0.5, 1)).alias("lo")
    )
    return rounded(
        c.select(
            "user_id",
            numeric.ratio("hi", "lo", "null").alias("r_null"),
            numeric.ratio("hi", "lo", "zero").alias("r_zero"),
            numeric.ratio("hi", "lo", "max1").alias("r_max1"),
        )
    )


# X-01
@query("""SELECT protocol_hint, count(*) AS n, round(avg(value), 6) AS mean_value FROM flows
  WHERE protocol_hint IN ('wifi', 'mqtt') GROUP BY 1""", ("flows",))
def filter_protocols(spark, sf):
    f = combine.where_in(flows(spark, sf), "protocol_hint", ["wifi", "mqtt"])
    return rounded(f.groupBy("protocol_hint").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


# X-02
@query("""SELECT source_row_index, protocol_hint FROM flows WHERE label = 0 AND protocol_hint IN ('mqtt', 'bluetooth')""",
       ("flows",))
def filter_benign(spark, sf):
    f = combine.benign_rows(flows(spark, sf), label="label", protocol="protocol_hint", protocols=["mqtt", "bluetooth"])
    return f.select("source_row_index", "protocol_hint")


# X-03
@query("""SELECT source_row_index, score FROM flows WHERE prediction = 1 AND score >= threshold AND score < 0.9999::DOUBLE""",
       ("flows",))
def filter_dynamic_alerts(spark, sf):
    return flows(spark, sf).where(replay.dynamic_alert("score")).select("source_row_index", "score")


# X-05
@query("""SELECT protocol_hint, count(*) AS n FROM flows WHERE abs(k_score - 0.25) <= 1e-12 GROUP BY 1""", ("flows",))
def filter_epsilon_equal(spark, sf):
    f = combine.where_near(flows(spark, sf), "k_score", 0.25)
    return f.groupBy("protocol_hint").agg(F.count("*").alias("n"))


# X-06
@query("""SELECT source_row_index, attack_family FROM flows WHERE prediction = 1 AND protocol_hint = 'wifi'
  AND contains(lower(attack_family), 'cli')""", ("flows",))
def search_alerts(spark, sf):
    return replay.search_alerts(flows(spark, sf), protocol="wifi", family=" CLI ").select(
        "source_row_index", "attack_family"
    )


# X-09
@query(f"""WITH {MESSY} SELECT count(*) AS n, round(sum({NUM}), 4) AS total FROM messy
  WHERE {NUM} IS NOT NULL AND NOT isnan({NUM}) AND NOT isinf({NUM})""", ("flows",))
def filter_finite(spark, sf):
    v = F.trim("txt").try_cast("double")
    m = messy(spark, sf).select(v.alias("v")).where(coerce.is_finite("v"))
    return rounded(m.agg(F.count("*").alias("n"), F.sum("v").alias("total")), 4)


