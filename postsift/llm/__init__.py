"""Operators of a training-data pipeline, one module each, and their queries."""

from __future__ import annotations

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
