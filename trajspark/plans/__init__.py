"""Composed jobs and the registered queries."""

from trajspark.plans import (  # noqa: F401
    benchmark_queries,
    diagnosis_queries,
    recovery_queries,
    reasoning_queries,
    repair_queries,
    source_queries,
    streaming_queries,
)
from trajspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
