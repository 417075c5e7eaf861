"""All queries of the engine itself, and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("turn_queries", "memory_queries", "retrieval_queries", "evaluation_queries", "source_queries")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
