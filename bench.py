"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "routed_scope_metrics",
    "line_confusion",
    "family_label_counts",
    "line_separability",
    "correlation_matrix",
    "value_counts_captures",
    "feature_quantiles",
    "iqr_outliers",
    "slice_metrics",
    "extended_metrics",
    "line_rank_metrics",
    "max_f1_at_fpr",
    "evaluate_grid",
    "select_threshold_gated_internal",
    "leakguard_val_split",
    "quota_sample",
    "bottom_k_by_margin",
    "round_robin_interleave",
    "running_counts",
    "rank_global",
    "feature_constraints",
    "scenario_metrics",
    "guarded_threshold_tune",
    "stream_score",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from flowlens.catalog import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("flowlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["class_balance"](spark, sf).collect()
    times, failed = {}, {}
    for name in HEADLINE:
        start = time.time()
        try:
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as exc:
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
    if failed:
        out["failed"] = failed
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
