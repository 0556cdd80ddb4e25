"""Registered queries and their SQL."""

from tapeloom.plans import bars_queries, ingest_queries, more_queries, norm_queries, perf_queries, pit_queries, recursive_queries, screen_queries  # noqa: F401
from tapeloom.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
