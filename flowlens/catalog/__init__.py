"""Every operator bound to the given tables, next to the SQL that checks it."""

from __future__ import annotations

from flowlens.catalog import (  # noqa: F401
    decision_queries,
    metric_queries,
    model_queries,
    perturb_queries,
    profile_queries,
    replay_queries,
    row_queries,
    sample_queries,
    source_queries,
    stream_queries,
    threshold_queries,
)
from flowlens.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
