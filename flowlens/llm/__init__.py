"""Operators for training data. Nothing else in the library imports this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Python workers get these modules' functions inside the task, so that a cluster needs no copy of this repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from flowlens.llm.queries import QUERIES, SQL  # noqa: E402

__all__ = ["QUERIES", "SQL"]
