"""Lenient parsing of text columns and row-level labels, margins and outcomes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.numeric import passes

INF = float("inf")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _trimmed(col: Column | str) -> Column:
    return F.trim(_c(col).cast("string"))


def safe_float_zero(col: Column | str) -> Column:
    """Number, or 0 for anything unparsable, NaN or infinite."""
    v = _trimmed(col).try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(INF)), F.lit(0.0)).otherwise(v)


def safe_float_missing(col: Column | str) -> Column:
    """``struct(value, is_missing)``: blank or unparsable gives (0, true); a NaN text stays NaN."""
    v = _trimmed(col).try_cast("double")
    return F.struct(F.coalesce(v, F.lit(0.0)).alias("value"), v.isNull().alias("is_missing"))


def coerce_feature(col: Column | str) -> Column:
    """Number with NULL and NaN as 0; infinities stay."""
    v = _trimmed(col).try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)


def coerce_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Coerce the named feature columns; absent ones become 0."""
    have = set(df.columns)
    return df.withColumns({f: coerce_feature(F.col(f"`{f}`")) if f in have else F.lit(0.0) for f in features})


def maybe_int(col: Column | str, default: int = 0) -> Column:
    """Integer part of a numeric text, or the default."""
    v = _trimmed(col).try_cast("double")
    return F.coalesce(F.when(~F.isnan(v), v.try_cast("bigint")), F.lit(default).cast("bigint"))


def normalize_label(col: Column | str) -> Column:
    """0 or 1: numbers are truncated and clipped, anything else is 0."""
    return F.least(F.greatest(maybe_int(col, 0), F.lit(0)), F.lit(1)).cast("int")


def label_eq_one(col: Column | str) -> Column:
    """1 only when the integer value is exactly 1."""
    return F.when(maybe_int(col, 0) == 1, F.lit(1)).otherwise(F.lit(0))


def protocol_slug(col: Column | str) -> Column:
    """Lower-case name with every non-alphanumeric replaced by ``_``; blank gives ``unknown``."""
    s = F.regexp_replace(F.lower(_trimmed(col)), r"[^\p{L}\p{N}]", "_")
    s = F.btrim(s, F.lit("_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def slug_text(name: str | None) -> str:
    """``protocol_slug`` of one name that is known beforehand, such as a model's key."""
    slug = re.sub(r"[\W_]", "_", (name or "").strip().lower()).strip("_")
    return slug or "unknown"


def default_string(col: Column | str, default: str = "unknown") -> Column:
    return F.coalesce(F.nullif(_trimmed(col), F.lit("")), F.lit(default))


def feature_name_key(col: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(col)), r"[^\p{L}\p{N}]", "")


def scalar_sanitize(col: Column | str) -> Column:
    """NaN, infinite or NULL numbers become 0 for output rows."""
    c = _c(col).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(0.0)).otherwise(c)


def is_finite(col: Column | str) -> Column:
    c = _c(col).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def classify_outcome(label: Column | str, pred: Column | str) -> Column:
    y, p = _c(label), _c(pred)
    return (
        F.when((y == 1) & (p == 1), F.lit("TP"))
        .when((y == 0) & (p == 0), F.lit("TN"))
        .when((y == 0) & (p == 1), F.lit("FP"))
        .otherwise(F.lit("FN"))
    )


def margin(score: Column | str, threshold: Column | str) -> Column:
    return _c(score) - _c(threshold)


def prediction(score: Column | str, threshold: Column | str) -> Column:
    """Inclusive: a score on the threshold is an alert."""
    return passes(score, threshold).cast("int")


def prediction_label(pred: Column | str) -> Column:
    return F.when(_c(pred) == 1, F.lit("attack")).otherwise(F.lit("benign"))


def direction(contribution: Column | str) -> Column:
    return F.when(_c(contribution) >= 0, F.lit("attack")).otherwise(F.lit("benign"))
