"""Registered queries of the engine proper, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from brindle.plans import embedding_queries, graph_queries, matching_queries, triple_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (triple_queries, matching_queries, graph_queries, embedding_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
