"""Registered queries over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import book_queries, market_queries
from .plans.registry import Query

REGISTRIES = (market_queries.R, book_queries.R)
QUERIES: dict[str, Query] = {name: f for r in REGISTRIES for name, f in r.queries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for r in REGISTRIES for name, sql in r.oracle.items()}
