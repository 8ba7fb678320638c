"""All registered queries and their DuckDB equivalents."""

from __future__ import annotations

from corpusmill.plans import audit_queries, eval_queries, log_queries, relational_queries, source_queries, text_queries, training_queries  # noqa: F401
from corpusmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
