"""Operators for preparing training text, and their registered queries."""

from sweepfield.llm.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
