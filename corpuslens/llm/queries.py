"""Queries of the llm problems, with SQL where it can say them on whole tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ["queries_groups", "queries_texts", "queries_near", "queries_vectors", "queries_abuse"]
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in MODULES:
    _x = import_module(f"corpuslens.llm.{_m}")
    QUERIES |= _x.QUERIES
    SQL |= _x.SQL
