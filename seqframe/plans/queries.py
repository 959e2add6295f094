"""All registered queries."""

from . import group_queries, interval_queries, seq_queries, source_queries, stats_queries  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
