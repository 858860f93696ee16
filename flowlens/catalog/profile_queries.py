"""Class balance, drift, separability, outliers, quantiles and capture statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.base import FEATURES, flows, line_flows, query, rounded, table
from flowlens.operators import metrics, profile

LINE_FEATURES = ["quantity", "price", "discount", "tax"]


def unpivot_sql(source: str, ids: list[str], features: list[str]) -> str:
    keep = "".join(f"{i}, " for i in ids)
    return " UNION ALL ".join(f"SELECT {keep}'{f}' AS feature, {f} AS value FROM {source}" for f in features)


# A-01
@query("""SELECT CASE WHEN label = 1 THEN 'attack' ELSE 'benign' END AS label, count(*) AS rows,
  round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM flows GROUP BY 1""", ("flows",))
def class_balance(spark, sf):
    return rounded(profile.class_balance(flows(spark, sf), label="label"))


BALANCE = """count(*) AS rows, count(*) FILTER (WHERE label = 0) AS benign_rows, count(*) FILTER (WHERE label = 1) AS attack_rows,
  round(count(*) FILTER (WHERE label = 0) / count(*)::DOUBLE, 6) AS benign_ratio,
  round(count(*) FILTER (WHERE label = 1) / count(*)::DOUBLE, 6) AS attack_ratio"""


# A-02
@query(f"SELECT split, {BALANCE} FROM flows GROUP BY split", ("flows",))
def split_label_balance(spark, sf):
    return rounded(profile.label_balance(flows(spark, sf), by=["split"], label="label"))


# A-03
@query(f"SELECT protocol_hint, {BALANCE} FROM flows WHERE split = 'test' GROUP BY protocol_hint", ("flows",))
def protocol_label_counts(spark, sf):
    test = flows(spark, sf).where(F.col("split") == "test")
    return rounded(profile.label_balance(test, by=["protocol_hint"], label="label").orderBy(F.col("rows").desc()))


# A-03 at volume
@query(f"SELECT protocol_hint, attack_family, {BALANCE} FROM line_flows GROUP BY 1, 2", ("line_flows",))
def family_label_counts(spark, sf):
    return rounded(profile.label_balance(line_flows(spark, sf), by=["protocol_hint", "attack_family"], label="label"))


# A-04
@query("""SELECT attack_family, count(*) AS rows, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM flows
  WHERE label = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""", ("flows",))
def value_counts_attacks(spark, sf):
    attacks = flows(spark, sf).where(F.col("label") == 1)
    return rounded(profile.value_counts(attacks, col="attack_family", top=25))


@query("""SELECT source_relpath, count(*) AS rows, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share
  FROM line_flows GROUP BY 1""", ("line_flows",))
def value_counts_captures(spark, sf):
    return rounded(profile.value_counts(line_flows(spark, sf), col="source_relpath"))


# A-05
@query("""WITH c AS (SELECT protocol_hint, count(*) FILTER (WHERE split = 'train') AS train_rows,
    count(*) FILTER (WHERE split = 'test') AS test_rows FROM flows GROUP BY 1)
  SELECT *, round(train_rows / sum(train_rows) OVER ()::DOUBLE, 6) AS train_share,
    round(test_rows / sum(test_rows) OVER ()::DOUBLE, 6) AS test_share,
    round(test_rows / sum(test_rows) OVER ()::DOUBLE - train_rows / sum(train_rows) OVER ()::DOUBLE, 6)
      AS share_diff_test_minus_train FROM c""", ("flows",))
def split_shift(spark, sf):
    return rounded(profile.split_shift(flows(spark, sf), col="protocol_hint", split="split"))


# A-06
@query("""WITH f AS (SELECT attack_family FROM flows GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
    p AS (SELECT protocol_hint FROM flows GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8),
    c AS (SELECT attack_family, protocol_hint, count(*) AS n FROM flows GROUP BY 1, 2)
  SELECT f.attack_family, p.protocol_hint, coalesce(c.n, 0) AS n FROM f CROSS JOIN p
    LEFT JOIN c ON c.attack_family = f.attack_family AND c.protocol_hint = p.protocol_hint""", ("flows",))
def crosstab(spark, sf):
    return profile.crosstab(
        flows(spark, sf), rows="attack_family", cols="protocol_hint", top_rows=10, top_cols=8
    )


SEP = """WITH l AS ({long}), a AS (SELECT feature, count(*) FILTER (WHERE label = 0) AS benign_n,
      count(*) FILTER (WHERE label = 1) AS attack_n,
      avg(coalesce(value, 0)) FILTER (WHERE label = 0) AS m0, avg(coalesce(value, 0)) FILTER (WHERE label = 1) AS m1,
      var_pop(coalesce(value, 0)) FILTER (WHERE label = 0) AS v0, var_pop(coalesce(value, 0)) FILTER (WHERE label = 1) AS v1,
      count(*) FILTER (WHERE label = 0 AND coalesce(value, 0) = 0) AS z0,
      count(*) FILTER (WHERE label = 1 AND coalesce(value, 0) = 0) AS z1,
      count(*) FILTER (WHERE label = 0 AND value IS NULL) AS x0,
      count(*) FILTER (WHERE label = 1 AND value IS NULL) AS x1 FROM l GROUP BY feature)
  SELECT feature, benign_n, attack_n, round(m0, 6) AS benign_mean, round(m1, 6) AS attack_mean,
    round(sqrt(v0), 6) AS benign_std, round(sqrt(v1), 6) AS attack_std,
    round(coalesce((m1 - m0) / nullif(sqrt(((benign_n - 1) * v0 + (attack_n - 1) * v1) / (benign_n + attack_n - 2)), 0), 0), 6)
      AS cohens_d, round(z0 / benign_n::DOUBLE, 6) AS benign_zero_rate, round(z1 / attack_n::DOUBLE, 6) AS attack_zero_rate,
    round(x0 / benign_n::DOUBLE, 6) AS benign_missing_rate, round(x1 / attack_n::DOUBLE, 6) AS attack_missing_rate
  FROM a WHERE benign_n >= 10 AND attack_n >= 10"""


# A-07, X-07
@query(SEP.format(long=unpivot_sql(
    "(SELECT label, value, k, hr, CASE WHEN hr >= 12 THEN k END AS k_night FROM flows)", ["label"],
    ["value", "k", "hr", "k_night"])), ("flows",))
def feature_separability(spark, sf):
    f = flows(spark, sf).withColumn("k_night", F.when(F.col("hr") >= 12, F.col("k")))
    return rounded(profile.feature_separability(f, features=[*FEATURES, "k_night"], label="label"))


@query(SEP.format(long=unpivot_sql("line_flows", ["label"], LINE_FEATURES)), ("line_flows",))
def line_separability(spark, sf):
    return rounded(profile.feature_separability(line_flows(spark, sf), features=LINE_FEATURES, label="label"))


# A-08
@query(f"""WITH l AS ({unpivot_sql("flows", [], FEATURES)}), q AS (SELECT feature, quantile_cont(value, 0.25) AS q1,
      quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1 HAVING q3 > q1 AND count(*) >= 20)
  SELECT feature, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
    round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence, count(*) AS n,
    count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier_count,
    round(min(value), 6) AS min_value, round(max(value), 6) AS max_value,
    round(count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*)::DOUBLE, 6)
      AS outlier_rate
  FROM l JOIN q USING (feature) GROUP BY feature, q1, q3""", ("flows",))
def iqr_outliers(spark, sf):
    return rounded(profile.iqr_outliers(flows(spark, sf), features=FEATURES))


# A-09
@query(f"""WITH l AS ({unpivot_sql("flows", ["label"], FEATURES)})
  SELECT feature, label, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25,
    round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
    round(quantile_cont(value, 0.9), 6) AS p90, min(value) AS min_value, max(value) AS max_value FROM l GROUP BY 1, 2""",
  ("flows",))
def feature_quantiles(spark, sf):
    return rounded(profile.feature_quantiles(flows(spark, sf), features=FEATURES, label="label"))


# A-10
@query("""SELECT i AS feature_i, j AS feature_j, round(r, 6) AS r FROM (
    SELECT corr(quantity, price) AS qp, corr(discount, quantity) AS dq, corr(discount, price) AS dp FROM line_flows) c,
    LATERAL (VALUES ('quantity', 'quantity', 1::DOUBLE), ('price', 'price', 1), ('discount', 'discount', 1),
      ('quantity', 'price', qp), ('price', 'quantity', qp), ('discount', 'quantity', dq), ('quantity', 'discount', dq),
      ('discount', 'price', dp), ('price', 'discount', dp)) v(i, j, r)""", ("line_flows",))
def correlation_matrix(spark, sf):
    return rounded(profile.correlation_matrix(line_flows(spark, sf), features=["quantity", "price", "discount"]))


# A-11
@query("""WITH e AS (SELECT label, min(value) AS lo, max(value) AS hi FROM flows GROUP BY 1)
  SELECT f.label, CAST(least(floor((value - lo) / ((hi - lo) / 36::DOUBLE)), 35) AS INTEGER) AS bin, count(*) AS rows
  FROM flows f JOIN e ON f.label = e.label GROUP BY 1, 2""", ("flows",))
def histogram(spark, sf):
    return profile.histogram(flows(spark, sf), value="value", by="label")


# A-21
@query("""SELECT protocol_hint, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.95), 6) AS p95 FROM flows GROUP BY 1""", ("flows",))
def summary_stats(spark, sf):
    return rounded(metrics.summary_stats(flows(spark, sf), "value", ["protocol_hint"]))


# A-24
@query(f"""WITH l AS ({unpivot_sql("line_flows", [], LINE_FEATURES)})
  SELECT feature, round(avg(value), 6) AS mean, round(CASE WHEN coalesce(stddev_samp(value), 0) <= 1e-12 THEN 1
    ELSE stddev_samp(value) END, 6) AS std FROM l GROUP BY 1""", ("line_flows",))
def standardizer(spark, sf):
    return rounded(profile.standardizer(line_flows(spark, sf), features=LINE_FEATURES))


@query("""SELECT source_row_index, round((value - m) / s, 6) AS value FROM flows,
  (SELECT avg(value) AS m, stddev_pop(value) AS s FROM flows)""", ("flows",))
def apply_standardizer(spark, sf):
    f = flows(spark, sf)
    row = profile.standardizer(f, features=["value"], sample=False).first()
    out = profile.apply_standardizer(f.select("source_row_index", "value"), {"value": (row["mean"], row["std"])})
    return rounded(out)


# A-25
@query("""SELECT protocol_hint, n, p AS n_pos, q AS n_neg, round(n / (2 * q)::DOUBLE, 6) AS weight_benign,
    round(n / (2 * p)::DOUBLE, 6) AS weight_attack, round(coalesce(q / nullif(p, 0)::DOUBLE, 1), 6) AS scale_pos_weight
  FROM (SELECT protocol_hint, count(*) AS n, count(*) FILTER (WHERE label = 1) AS p,
      count(*) FILTER (WHERE label = 0) AS q FROM flows GROUP BY 1)""", ("flows",))
def class_weights(spark, sf):
    return rounded(profile.class_weights(flows(spark, sf), label="label", by=["protocol_hint"]))


# A-26, A-28
@query("""WITH c AS (SELECT protocol_hint, label, source_relpath, count(*) AS n, count(*) FILTER (WHERE split = 'test') AS v
    FROM flows GROUP BY 1, 2, 3)
  SELECT protocol_hint, label, CAST(sum(n) AS BIGINT) AS rows, count(*) AS unique_files, CAST(sum(v) AS BIGINT) AS val_rows,
    round(max(n) / sum(n)::DOUBLE, 6) AS largest_file_share, round(1 / nullif(sum(v), 0)::DOUBLE, 6) AS fpr_resolution,
    200 AS min_required, sum(v) >= 200 AS strict_fpr_feasible FROM c GROUP BY 1, 2""", ("flows",))
def capture_stats(spark, sf):
    f = flows(spark, sf).withColumn("is_val", F.col("split") == "test")
    s = profile.capture_stats(f, strata=["protocol_hint", "label"], capture="source_relpath", is_val="is_val")
    return rounded(profile.fpr_feasibility(s, max_fpr=0.005))


# A-27
@query("SELECT protocol_hint, label, count(*) AS rows FROM line_flows GROUP BY 1, 2", ("line_flows",))
def stratum_counts(spark, sf):
    return profile.stratum_counts(line_flows(spark, sf), strata=["protocol_hint", "label"])


# A-37
@query("""SELECT attack_family, count(p) AS covered_rows, count(*) AS rows, round(count(p) / count(*)::DOUBLE, 6) AS coverage
  FROM (SELECT attack_family, CASE WHEN protocol_hint <> 'mqtt' OR k >= 10 THEN prediction END AS p FROM flows)
  GROUP BY 1""", ("flows",))
def coverage(spark, sf):
    p = F.when((F.col("protocol_hint") != "mqtt") | (F.col("k") >= 10), F.col("prediction"))
    return rounded(metrics.coverage(flows(spark, sf).withColumn("p", p), "p", ["attack_family"]))


# X-07
@query("""WITH s AS (SELECT source_relpath, label, CASE WHEN split = 'test' THEN 'test' WHEN k < 30 THEN 'val' ELSE 'train' END
      AS part FROM flows), c AS (SELECT source_relpath, count(*) FILTER (WHERE part = 'train') AS train_rows,
      count(*) FILTER (WHERE part = 'val') AS val_rows, count(*) FILTER (WHERE part = 'test') AS test_rows,
      count(*) FILTER (WHERE part = 'train' AND label = 0) AS t0, count(*) FILTER (WHERE part = 'train' AND label = 1) AS t1,
      count(*) FILTER (WHERE part = 'val' AND label = 0) AS v0, count(*) FILTER (WHERE part = 'val' AND label = 1) AS v1
    FROM s GROUP BY 1)
  SELECT source_relpath, train_rows, val_rows, test_rows, CASE WHEN train_rows < 2 THEN 'too_few_train_rows'
      WHEN val_rows < 2 THEN 'too_few_val_rows' WHEN test_rows < 1 THEN 'too_few_test_rows'
      WHEN t0 = 0 OR t1 = 0 THEN 'single_class_train' WHEN v0 = 0 OR v1 = 0 THEN 'single_class_val' ELSE '' END AS skip_reason
  FROM c""", ("flows",))
def protocol_support(spark, sf):
    part = F.when(F.col("split") == "test", F.lit("test")).when(F.col("k") < 30, F.lit("val")).otherwise(F.lit("train"))
    f = flows(spark, sf).withColumn("part", part)
    return profile.protocol_support(f, by="source_relpath", label="label", part="part")


# labelled documents as a second natural source
@query("""SELECT lang, source, count(*) AS rows, count(*) FILTER (WHERE quality = 0) AS benign_rows,
    count(*) FILTER (WHERE quality = 1) AS attack_rows,
    round(count(*) FILTER (WHERE quality = 0) / count(*)::DOUBLE, 6) AS benign_ratio,
    round(count(*) FILTER (WHERE quality = 1) / count(*)::DOUBLE, 6) AS attack_ratio
  FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def document_label_balance(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id")
    return rounded(profile.label_balance(d, by=["lang", "source"], label="quality"))
