"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Modules that hold queries.
MODULES = ("licenses", "langid", "toxicity", "tokens", "pieces", "voronoi", "warc", "substrings", "jaccard", "decontaminate", "changepoints", "dialogue", "simhash")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
