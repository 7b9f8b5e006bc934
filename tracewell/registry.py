"""Queries of the engine's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from tracewell.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
