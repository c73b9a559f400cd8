"""Composed query plans and their DuckDB oracle SQL."""

from shelfrank.plans import queries as _queries  # noqa: F401  (registers the queries)
from shelfrank.plans.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
