"""Query registry and the bindings of the given tables to flow, candidate and capture tables.

Each binding exists twice: as a DataFrame and as the common table expressions the checking SQL starts from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.functions.hashing import md5_bucket
from flowlens.operators.score import LinearModel, by_protocol

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL (after the CTEs it needs) that gives the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            body = sql.strip()
            ctes = ",\n".join(CTES[n] for n in needs)
            if ctes and body[:5].upper() == "WITH ":
                SQL[fn.__name__] = f"WITH {ctes},\n{body[5:]}"
            elif ctes:
                SQL[fn.__name__] = f"WITH {ctes}\n{body}"
            else:
                SQL[fn.__name__] = body
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that summation order does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- flows: one row per event ------------------------------------------------------------------------------------

FEATURES = ["value", "k", "hr"]
LOCKABLE = ["value", "k", "hr", "f_flag"]
RELATED = ["f_min", "f_avg", "f_max", "f_tot", "f_number", "f_srate", "f_drate", "f_rate"]
ROLES = dict(zip(("min", "avg", "max", "tot_sum", "number", "srate", "drate", "rate"), RELATED))
ROLE_INDEX = {r: i for i, r in enumerate(ROLES)}
PROTOCOLS = ["wifi", "mqtt", "bluetooth"]
THRESHOLDS = {"wifi": 0.55, "mqtt": 0.5, "bluetooth": 0.6}

MODELS = {
    "wifi": LinearModel({"value": 0.03, "k": 0.05, "hr": 0.01}, -3.7),
    "mqtt": LinearModel({"value": 0.025, "k": 0.055, "hr": 0.005}, -3.5),
    "bluetooth": LinearModel({"value": 0.035, "k": 0.045, "hr": -0.01}, -3.6),
}


def flows(spark: SparkSession, sf: str) -> DataFrame:
    return flows_of(table(spark, sf, "events"))


def flows_of(events: DataFrame) -> DataFrame:
    """The flow binding of an events table or stream."""
    kind = F.col("event_type")
    df = events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_relpath"),
        F.col("event_id").alias("source_row_index"),
        "ts",
        F.when(kind == "signup", F.lit("mqtt"))
        .when(kind == "purchase", F.lit("bluetooth"))
        .otherwise(F.lit("wifi"))
        .alias("protocol_hint"),
        kind.alias("attack_family"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.hour("ts").cast("double").alias("hr"),
    )
    v, k, hr = F.col("value"), F.col("k"), F.col("hr")
    z = F.lit(0.03) * v + F.lit(0.05) * k - F.lit(3.6)
    number = F.lit(1.0) + (k - F.lit(10.0) * F.floor(k / F.lit(10.0)))
    rate = v + F.lit(1.0)
    return df.withColumns(
        {
            "label": (v + k >= 90).cast("int"),
            "score": F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6),
            "k_score": k / F.lit(100.0),
            "threshold": by_protocol(F.col("protocol_hint"), {p: F.lit(t) for p, t in THRESHOLDS.items()}),
            "split": F.when(md5_bucket("source_relpath", 100) < 20, F.lit("test")).otherwise(F.lit("train")),
            "f_flag": (k >= 50).cast("double"),
            "f_min": v * F.lit(0.5),
            "f_avg": v,
            "f_max": v + F.lit(0.5) * k,
            "f_tot": number * v * (F.lit(1.0) + hr / F.lit(100.0)),
            "f_number": number,
            "f_srate": F.lit(0.6) * rate + k / F.lit(50.0),
            "f_drate": F.lit(0.4) * rate,
            "f_rate": rate,
        }
    ).withColumn("prediction", (F.col("score") >= F.col("threshold")).cast("int"))


def md5_bucket_sql(text: str, modulus: int = 100) -> str:
    """The md5 digest of a text modulo m, folded from four 32-bit words."""
    shift = (1 << 32) % modulus
    out = "0"
    for start in (1, 9, 17, 25):
        word = f"CAST(concat('0x', substr(md5({text}), {start}, 8)) AS BIGINT)"
        out = f"(({out} * {shift} + {word}) % {modulus})"
    return f"CAST({out} AS INTEGER)"


def row_hash_sql(*parts: str, seed: int) -> str:
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(concat('0x', substr(md5(concat_ws('#', {text}, '{seed}')), 1, 15)) AS BIGINT)"


CTES: dict[str, str] = {}
CTES["flows"] = f"""flows0 AS (
  SELECT concat('u', CAST(user_id AS VARCHAR)) AS source_relpath, event_id AS source_row_index, ts,
    CASE event_type WHEN 'signup' THEN 'mqtt' WHEN 'purchase' THEN 'bluetooth' ELSE 'wifi' END AS protocol_hint,
    event_type AS attack_family, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    CAST(extract('hour' FROM ts) AS DOUBLE) AS hr
  FROM events),
flows1 AS (
  SELECT *, CAST(value + k >= 90 AS INTEGER) AS label,
    round(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-(CAST(0.03 AS DOUBLE) * value + CAST(0.05 AS DOUBLE) * k
      - CAST(3.6 AS DOUBLE)))), 6) AS score,
    k / CAST(100 AS DOUBLE) AS k_score,
    CAST(CASE protocol_hint WHEN 'wifi' THEN 0.55 WHEN 'mqtt' THEN 0.5 ELSE 0.6 END AS DOUBLE) AS threshold,
    CASE WHEN {md5_bucket_sql("source_relpath")} < 20 THEN 'test' ELSE 'train' END AS split,
    CAST(k >= 50 AS DOUBLE) AS f_flag, value * CAST(0.5 AS DOUBLE) AS f_min, value AS f_avg,
    value + CAST(0.5 AS DOUBLE) * k AS f_max,
    CAST(1 AS DOUBLE) + (k - CAST(10 AS DOUBLE) * floor(k / CAST(10 AS DOUBLE))) AS f_number,
    value + CAST(1 AS DOUBLE) AS f_rate
  FROM flows0),
flows AS (
  SELECT *, f_number * value * (CAST(1 AS DOUBLE) + hr / CAST(100 AS DOUBLE)) AS f_tot,
    CAST(0.6 AS DOUBLE) * f_rate + k / CAST(50 AS DOUBLE) AS f_srate, CAST(0.4 AS DOUBLE) * f_rate AS f_drate,
    CAST(score >= threshold AS INTEGER) AS prediction
  FROM flows1)"""


# ---- scored flows: the routed linear models ------------------------------------------------------------------------

CTES["scored"] = """scored0 AS (
  SELECT f.*, protocol_hint AS protocol_used,
    CASE protocol_hint WHEN 'wifi' THEN 0.03 WHEN 'mqtt' THEN 0.025 ELSE 0.035 END::DOUBLE AS w_value,
    CASE protocol_hint WHEN 'wifi' THEN 0.05 WHEN 'mqtt' THEN 0.055 ELSE 0.045 END::DOUBLE AS w_k,
    CASE protocol_hint WHEN 'wifi' THEN 0.01 WHEN 'mqtt' THEN 0.005 ELSE -0.01 END::DOUBLE AS w_hr,
    CASE protocol_hint WHEN 'wifi' THEN -3.7 WHEN 'mqtt' THEN -3.5 ELSE -3.6 END::DOUBLE AS w_b
  FROM flows f),
scored AS (
  SELECT * EXCLUDE (prediction), CAST(score_attack >= threshold AS INTEGER) AS prediction,
    score_attack - threshold AS margin, abs(score_attack - threshold) AS abs_margin
  FROM (SELECT *, 1::DOUBLE / (1::DOUBLE + exp(-(w_b + w_value * value + w_k * k + w_hr * hr))) AS score_attack
        FROM scored0))"""


def count_sql(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


# ---- lineitem: the volume binding --------------------------------------------------------------------------------


def line_flows(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_relpath"),
        F.when(flag == "R", F.lit("wifi")).when(flag == "A", F.lit("mqtt")).otherwise(F.lit("bluetooth")).alias(
            "protocol_hint"
        ),
        F.concat("l_returnflag", "l_linestatus").alias("attack_family"),
        (F.col("l_linestatus") == "F").cast("int").alias("label"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_quantity") / F.lit(50.0)).alias("score"),
    )


CTES["line_flows"] = """line_flows AS (
  SELECT concat('s', CAST(l_suppkey AS VARCHAR)) AS source_relpath,
    CASE l_returnflag WHEN 'R' THEN 'wifi' WHEN 'A' THEN 'mqtt' ELSE 'bluetooth' END AS protocol_hint,
    concat(l_returnflag, l_linestatus) AS attack_family, CAST(l_linestatus = 'F' AS INTEGER) AS label,
    l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_shipdate AS ts,
    l_quantity / 50::DOUBLE AS score
  FROM lineitem)"""


# ---- capture paths derived from events ------------------------------------------------------------------------------


def capture_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event with the path of the capture it would sit in."""
    u, kind = F.col("user_id").cast("string"), F.col("event_type")
    m = lambda n: F.pmod(F.col("user_id"), F.lit(n))

    def path(prefix: str, suffix: str) -> Column:
        return F.concat(F.lit(prefix), u, F.lit(suffix))

    p = (
        F.when(kind == "click", path("WiFI_and_MQTT/attacks/csv/train/TCP_IP-DDoS-UDP", "_train.pcap.csv"))
        .when(kind == "view", path("WiFI_and_MQTT/attacks/csv/test/Recon-Scan", "_test.pcap.csv"))
        .when((kind == "error") & (m(5) == 0), path("WiFI_and_MQTT/attacks/pcap/train/raw", ".pcap"))
        .when((kind == "error") & (m(2) == 0), path("WiFI_and_MQTT/attacks/csv/train/Benign", "_train.pcap.csv"))
        .when(kind == "error", path("WiFI_and_MQTT/attacks/csv/test/ARP_Spoofing", "_test.pcap.csv"))
        .when(
            (kind == "signup") & (m(4) == 0),
            path("WiFI_and_MQTT/attacks/csv/test/MQTT-DoS-Connect_Flood", "_test.pcap.csv"),
        )
        .when(
            (kind == "signup") & (m(4) == 1),
            path("WiFI_and_MQTT/attacks/csv/train/MQTT-Malformed_Data", "_train.pcap.csv"),
        )
        .when((kind == "signup") & (m(4) == 2), path("WiFI_and_MQTT/profiling/csv/Cam", "_LAN_Photo.csv"))
        .when(kind == "signup", path("WiFI_and_MQTT/profiling/csv/Broker", "_WAN_Sync.csv"))
        .when((kind == "purchase") & (m(3) == 0), path("Bluetooth/attacks/csv/test/Bluetooth_DoS", "_test.pcap.csv"))
        .when((kind == "purchase") & (m(3) == 1), path("Bluetooth/profiling/csv/Plug", "_Power.csv"))
        .otherwise(path("Bluetooth/profiling/csv/", "/Idle.csv"))
    )
    return table(spark, sf, "events").select("event_id", "value", p.alias("source_relpath"))


CTES["capture_rows"] = """capture_rows AS (
  SELECT event_id, value, CASE
    WHEN event_type = 'click' THEN concat('WiFI_and_MQTT/attacks/csv/train/TCP_IP-DDoS-UDP', u, '_train.pcap.csv')
    WHEN event_type = 'view' THEN concat('WiFI_and_MQTT/attacks/csv/test/Recon-Scan', u, '_test.pcap.csv')
    WHEN event_type = 'error' AND user_id % 5 = 0 THEN concat('WiFI_and_MQTT/attacks/pcap/train/raw', u, '.pcap')
    WHEN event_type = 'error' AND user_id % 2 = 0
      THEN concat('WiFI_and_MQTT/attacks/csv/train/Benign', u, '_train.pcap.csv')
    WHEN event_type = 'error' THEN concat('WiFI_and_MQTT/attacks/csv/test/ARP_Spoofing', u, '_test.pcap.csv')
    WHEN event_type = 'signup' AND user_id % 4 = 0
      THEN concat('WiFI_and_MQTT/attacks/csv/test/MQTT-DoS-Connect_Flood', u, '_test.pcap.csv')
    WHEN event_type = 'signup' AND user_id % 4 = 1
      THEN concat('WiFI_and_MQTT/attacks/csv/train/MQTT-Malformed_Data', u, '_train.pcap.csv')
    WHEN event_type = 'signup' AND user_id % 4 = 2 THEN concat('WiFI_and_MQTT/profiling/csv/Cam', u, '_LAN_Photo.csv')
    WHEN event_type = 'signup' THEN concat('WiFI_and_MQTT/profiling/csv/Broker', u, '_WAN_Sync.csv')
    WHEN event_type = 'purchase' AND user_id % 3 = 0
      THEN concat('Bluetooth/attacks/csv/test/Bluetooth_DoS', u, '_test.pcap.csv')
    WHEN event_type = 'purchase' AND user_id % 3 = 1 THEN concat('Bluetooth/profiling/csv/Plug', u, '_Power.csv')
    ELSE concat('Bluetooth/profiling/csv/', u, '/Idle.csv') END AS source_relpath
  FROM (SELECT *, CAST(user_id AS VARCHAR) AS u FROM events))"""


# ---- candidates: metric rows per model, family, seed and protocol, aggregated from lineitem --------------------------


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    part = F.pmod("l_suppkey", F.lit(3))
    c = (
        table(spark, sf, "lineitem")
        .groupBy(
            F.when(F.col("l_returnflag") == "A", F.lit("xgboost"))
            .when(F.col("l_returnflag") == "N", F.lit("catboost"))
            .otherwise(F.lit("mlp"))
            .alias("model_name"),
            F.col("l_linestatus").alias("family_id"),
            (F.lit(42) + F.pmod("l_linenumber", F.lit(2))).alias("seed"),
            F.when(part == 0, F.lit("wifi")).when(part == 1, F.lit("mqtt")).otherwise(F.lit("bluetooth")).alias(
                "protocol"
            ),
        )
        .agg(
            F.round(F.avg("l_discount") / F.lit(10.0), 6).alias("attacked_benign_fpr"),
            F.round(F.avg("l_tax") / F.lit(10.0), 6).alias("clean_fpr"),
            F.round(F.avg("l_quantity") / F.lit(25.8), 6).alias("adv_malicious_recall"),
            F.round(F.avg("l_extendedprice") / F.lit(60000.0), 6).alias("clean_f1"),
            F.round(F.avg(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))) / F.lit(60000.0), 6).alias(
                "robust_f1"
            ),
            F.count(F.when((F.col("l_quantity") >= 49) & (F.col("l_discount") >= 0.095), F.lit(1))).alias(
                "num_gate_pass"
            ),
            F.count("*").alias("n_val"),
        )
    )
    fpr_ok = F.col("attacked_benign_fpr") <= F.lit(0.00503)
    adv_ok = F.col("adv_malicious_recall") >= F.lit(0.985)
    return c.withColumns(
        {
            "gate_pass": fpr_ok & adv_ok,
            "gate_failure_category": F.when(fpr_ok & adv_ok, F.lit("none"))
            .when(fpr_ok, F.lit("adv_recall_only"))
            .when(adv_ok, F.lit("fpr_only"))
            .otherwise(F.lit("both")),
        }
    )


CTES["cand"] = """cand0 AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'xgboost' WHEN 'N' THEN 'catboost' ELSE 'mlp' END AS model_name,
    l_linestatus AS family_id, 42 + l_linenumber % 2 AS seed,
    CASE l_suppkey % 3 WHEN 0 THEN 'wifi' WHEN 1 THEN 'mqtt' ELSE 'bluetooth' END AS protocol,
    round(avg(l_discount) / 10, 6) AS attacked_benign_fpr, round(avg(l_tax) / 10, 6) AS clean_fpr,
    round(avg(l_quantity) / CAST(25.8 AS DOUBLE), 6) AS adv_malicious_recall,
    round(avg(l_extendedprice) / 60000, 6) AS clean_f1,
    round(avg(l_extendedprice * (1 - l_discount)) / 60000, 6) AS robust_f1,
    count(*) FILTER (WHERE l_quantity >= 49 AND l_discount >= CAST(0.095 AS DOUBLE)) AS num_gate_pass,
    count(*) AS n_val
  FROM lineitem GROUP BY 1, 2, 3, 4),
cand AS (
  SELECT *, attacked_benign_fpr <= CAST(0.00503 AS DOUBLE) AND adv_malicious_recall >= CAST(0.985 AS DOUBLE) AS gate_pass,
    CASE WHEN attacked_benign_fpr <= CAST(0.00503 AS DOUBLE)
           THEN CASE WHEN adv_malicious_recall >= CAST(0.985 AS DOUBLE) THEN 'none' ELSE 'adv_recall_only' END
         WHEN adv_malicious_recall >= CAST(0.985 AS DOUBLE) THEN 'fpr_only' ELSE 'both' END AS gate_failure_category
  FROM cand0)"""

CTES["gcand"] = """gcand AS (
  SELECT concat(model_name, '__', family_id, '__', CAST(seed AS VARCHAR)) AS candidate_key,
    concat(model_name, '__', family_id) AS candidate_group_key, model_name, family_id, seed,
    string_agg(protocol, ',' ORDER BY protocol) AS protocols_present, count(*) = 3 AS has_all_protocols,
    count(*) = 3 AND bool_and(gate_pass) AS gate_pass,
    CASE WHEN count(*) < 3 THEN 'missing_protocol_rows' WHEN bool_and(gate_pass) THEN 'none'
      ELSE array_to_string(list_sort(list(DISTINCT gate_failure_category)
             FILTER (WHERE gate_failure_category <> 'none')), ';') END AS gate_failure_category,
    CASE WHEN count(*) = 3 THEN max(attacked_benign_fpr) END AS worst_attacked_benign_fpr,
    CASE WHEN count(*) = 3 THEN max(clean_fpr) END AS worst_clean_fpr,
    CASE WHEN count(*) = 3 THEN min(adv_malicious_recall) END AS worst_adv_malicious_recall,
    CASE WHEN count(*) = 3 THEN avg(clean_f1) END AS mean_clean_f1,
    CASE WHEN count(*) = 3 THEN avg(robust_f1) END AS mean_robust_f1
  FROM cand GROUP BY model_name, family_id, seed),
granked AS (
  SELECT *, row_number() OVER (ORDER BY gate_pass DESC, worst_attacked_benign_fpr ASC NULLS LAST,
    worst_clean_fpr ASC NULLS LAST, worst_adv_malicious_recall DESC NULLS LAST, mean_clean_f1 DESC NULLS LAST,
    mean_robust_f1 DESC NULLS LAST, candidate_key) AS final_rank
  FROM gcand)"""


# ---- threshold pools ---------------------------------------------------------------------------------------------


def pools(spark: SparkSession, sf: str) -> DataFrame:
    """``(scope, pool, label, score)``: clean scores, raised benign scores and lowered attack scores."""
    f = flows(spark, sf).select(F.col("protocol_hint").alias("scope"), "label", "score")
    up = F.round(F.least(F.lit(1.0), F.col("score") * F.lit(1.02) + F.lit(0.01)), 6)
    down = F.round(F.greatest(F.lit(0.0), F.col("score") * F.lit(0.95) - F.lit(0.01)), 6)
    clean = f.withColumn("pool", F.lit("clean"))
    ben = f.where(F.col("label") == 0).withColumns({"pool": F.lit("adv_benign"), "score": up})
    mal = f.where(F.col("label") == 1).withColumns({"pool": F.lit("adv_malicious"), "score": down})
    return clean.unionByName(ben).unionByName(mal)


CTES["pools"] = """pools AS (
  SELECT protocol_hint AS scope, 'clean' AS pool, label, score FROM flows
  UNION ALL SELECT protocol_hint, 'adv_benign', label,
    round(least(1::DOUBLE, score * CAST(1.02 AS DOUBLE) + CAST(0.01 AS DOUBLE)), 6) FROM flows WHERE label = 0
  UNION ALL SELECT protocol_hint, 'adv_malicious', label,
    round(greatest(0::DOUBLE, score * CAST(0.95 AS DOUBLE) - CAST(0.01 AS DOUBLE)), 6) FROM flows WHERE label = 1)"""


def grid_ctes(points: int, base: float | None, clip: bool = True) -> str:
    """Candidate thresholds per scope and their counts, by comparing every row to every candidate."""
    lo, hi = ("greatest(0::DOUBLE, min(score))", "least(1::DOUBLE, max(score))") if clip else ("min(score)", "max(score)")
    extra = f"UNION SELECT scope, CAST({base} AS DOUBLE) FROM span" if base is not None else ""
    src = "pools" if clip else "pools WHERE pool = 'clean'"
    return f"""span AS (SELECT scope, {lo} AS lo, {hi} AS hi FROM {src} GROUP BY scope),
grid AS (
  SELECT scope, CASE WHEN i = {points - 1} THEN hi ELSE lo + CAST(i AS DOUBLE) * ((hi - lo) / {points - 1}::DOUBLE) END
    AS threshold FROM span, (SELECT unnest(range({points})) AS i)
  {extra}),
cnt AS (
  SELECT g.scope, g.threshold, count(*) FILTER (WHERE pool = 'clean' AND label = 1 AND score >= threshold) AS tp,
    count(*) FILTER (WHERE pool = 'clean' AND label = 0 AND score >= threshold) AS fp,
    count(*) FILTER (WHERE pool = 'clean' AND label = 1) AS n_pos,
    count(*) FILTER (WHERE pool = 'clean' AND label = 0) AS n_neg,
    count(*) FILTER (WHERE pool = 'adv_benign' AND score >= threshold) AS adv_fp,
    count(*) FILTER (WHERE pool = 'adv_malicious' AND score >= threshold) AS adv_tp,
    count(*) FILTER (WHERE pool = 'adv_benign') AS n_adv_benign,
    count(*) FILTER (WHERE pool = 'adv_malicious') AS n_adv_malicious
  FROM (SELECT DISTINCT scope, threshold FROM grid) g JOIN pools p ON p.scope = g.scope GROUP BY 1, 2),
ev AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS clean_precision,
    coalesce(tp / nullif(n_pos, 0)::DOUBLE, 0) AS clean_recall,
    coalesce(2 * tp / nullif(tp + fp + n_pos, 0)::DOUBLE, 0) AS clean_f1,
    coalesce(fp / nullif(n_neg, 0)::DOUBLE, 0) AS clean_fpr,
    adv_fp / nullif(n_adv_benign, 0)::DOUBLE AS attacked_benign_fpr,
    adv_tp / nullif(n_adv_malicious, 0)::DOUBLE AS attacked_malicious_recall
  FROM cnt)"""


# ---- curve points ------------------------------------------------------------------------------------------------


def points_ctes(source: str, scope: str, score: str, global_name: str | None = None) -> str:
    """Tie-grouped cumulative counts per scope in plain window SQL."""
    extra = f" UNION ALL SELECT '{global_name}', {score}, label FROM {source}" if global_name else ""
    return f"""sc AS (SELECT {scope} AS scope, {score} AS score, label FROM {source}{extra}),
hist AS (SELECT scope, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM sc GROUP BY 1, 2),
pts AS (SELECT scope, score, pos, neg,
    CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
    CAST(sum(pos) OVER (PARTITION BY scope) AS BIGINT) AS n_pos,
    CAST(sum(neg) OVER (PARTITION BY scope) AS BIGINT) AS n_neg
  FROM hist WINDOW w AS (PARTITION BY scope ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
rates AS (SELECT *, tp / nullif(n_pos, 0)::DOUBLE AS tpr, fp / nullif(n_neg, 0)::DOUBLE AS fpr,
    tp / greatest(tp + fp, 1)::DOUBLE AS prec FROM pts),
steps AS (SELECT *, lag(tpr, 1, 0::DOUBLE) OVER w AS tpr0, lag(fpr, 1, 0::DOUBLE) OVER w AS fpr0,
    lag(prec, 1, 1::DOUBLE) OVER w AS prec0
  FROM rates WINDOW w AS (PARTITION BY scope ORDER BY score DESC)),
ranks AS (SELECT scope,
    CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN sum((fpr - fpr0) * (tpr + tpr0) / 2) END AS roc_auc,
    coalesce(sum((tpr - tpr0) * prec), 0) AS pr_auc_step,
    coalesce(sum((tpr - tpr0) * (prec + prec0) / 2), 0) AS pr_auc_trapz
  FROM steps GROUP BY scope)"""
