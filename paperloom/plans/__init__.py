"""Registered queries: each applies an operator to the given tables, with its SQL."""

from paperloom.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
