"""Each operator on its whole table, with production parameters, next to the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm import alignment, credentials, decontaminate, hard_negatives, langid, language_model, mixing, pii, quality, rules, sharding, simhash, token_output
from flowlens.llm.common import fold_of, table, whole_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql.strip()
        return fn

    return register


@query()
def op1_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(table(spark, sf, "documents"))


@query()
def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "n_items", "item_words", "covered_words", "coverage", "tiles")


def secrets_sql() -> str:
    """Every pair of parts is compared here, where the operator joins cells."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    kinds = "\n  UNION ALL ".join(
        f"""SELECT doc_id, {rank} AS rank, {quoted(kind)} AS kind, {quoted(role)} AS role, {least} AS least, text,
    string_split_regex(text, {quoted(regex)}) AS gaps, regexp_extract_all(text, {quoted(regex)}, 0) AS matches,
    regexp_extract_all(text, {quoted(regex)}, {group}) AS counted FROM texts WHERE regexp_matches(text, {quoted(regex)})"""
        for rank, (kind, (regex, group, least, role)) in enumerate(credentials.PATTERNS.items(), 1)
    )
    base = ", ".join(map(quoted, credentials.BASE))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({kinds}),
pieces AS (
  SELECT doc_id, rank, kind, role, least, unnest(range(len(matches))) AS place,
    unnest(list_slice(gaps, 1, len(matches))) AS gap, unnest(matches) AS part, unnest(counted) AS counted FROM found),
placed AS (
  SELECT *, CAST(sum(length(gap) + length(part)) OVER (PARTITION BY doc_id, kind ORDER BY place) AS BIGINT) AS stop
  FROM pieces),
parts AS (
  SELECT doc_id, rank, kind, role, stop - length(part) AS start, stop, kind IN ({base}) AS base
  FROM placed WHERE length(counted) >= least),
free AS (
  SELECT * FROM parts p WHERE base OR NOT EXISTS (
    SELECT 1 FROM parts b WHERE b.base AND b.doc_id = p.doc_id AND b.start < p.stop AND b.stop > p.start)),
kept AS (
  SELECT * FROM free p WHERE base OR EXISTS (
    SELECT 1 FROM free o WHERE o.doc_id = p.doc_id AND abs(o.start - p.start) <= {credentials.SCOPE}
      AND (o.role = 'secret') <> (p.role = 'secret'))),
said AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank, stop) FILTER (base) AS base,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank, stop) AS spans
  FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN said USING (doc_id)
"""


@query(secrets_sql())
def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = credentials.scan(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(credentials.BASE))
    kinds = F.transform("spans", lambda s: s.kind)
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in credentials.BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(credentials.said(base), 256).alias("base_sha256"),
        credentials.said(F.col("spans")).alias("spans"),
    )


@query()
def op4_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(table(spark, sf, "documents"), shards=16)
    return placed.select(
        "doc_id",
        sharding.size_of().alias("size"),
        F.crc32(whole_text()).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    graded = quality.grade(docs.select("doc_id", "text"), model)
    return graded.select(
        "doc_id",
        (fold_of("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query()
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op7_token_output(spark: SparkSession, sf: str) -> DataFrame:
    records = token_output.training_order(table(spark, sf, "documents"))
    return records.select("doc_id", "seq", "slot", "shard", "offset", "n_tokens", "tokens")


@query()
def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.fit(langid.training_rows(docs))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "language.*")


@query()
def op9_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return rules.quality_rules(docs.select("doc_id", "text")).select("doc_id", "rules.*")


@query(
    r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))), 1, 15)
      AS BIGINT) AS key
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM rows GROUP BY source),
ranked AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(sum(3 * source_size) OVER upto - 3 * source_size AS BIGINT) AS most_before,
    CAST(sum(weight) OVER () - sum(weight) OVER upto + weight AS BIGINT) AS weight_left
  FROM sizes
  WINDOW upto AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
bounded AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) * weight_left <= CAST(total - most_before AS DOUBLE) * weight AS bound
  FROM ranked),
targets AS (
  SELECT source, source_size, CASE WHEN bound THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST((total - coalesce(sum(CASE WHEN bound THEN 3 * source_size END) OVER (), 0)) * weight AS DOUBLE)
      / CAST(sum(CASE WHEN NOT bound THEN weight END) OVER () AS DOUBLE) END AS target
  FROM bounded),
turns AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS turns FROM targets),
placed AS (
  SELECT r.*, t.source_size, t.target, t.turns, t.target - t.turns * t.source_size AS goal,
    CAST(sum(size) OVER (PARTITION BY r.source ORDER BY key) AS BIGINT) AS upto
  FROM rows r JOIN turns t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (turns + CASE WHEN goal > 0 AND upto * 2 - size <= goal * 2 THEN 1 ELSE 0 END) AS taken
FROM placed
"""
)
def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_table(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"))


@query(
    """
WITH found AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM found a JOIN found r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
    AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
)
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    label = F.col("label").cast("long")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(moved, F.col("vec_id") % 100 == 0)


@query()
def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found = alignment.align_tokenizers(table(spark, sf, "documents"))
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)


@query()
def op13_language_model(spark: SparkSession, sf: str) -> DataFrame:
    learn = fold_of("doc_id", 7) != 2
    found = language_model.log_probabilities(table(spark, sf, "documents"), learn)
    return found.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
