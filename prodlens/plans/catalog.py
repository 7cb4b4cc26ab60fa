"""Registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from . import phrase_queries, product_queries

_DEFINED: dict = {**phrase_queries.DEFINED, **product_queries.DEFINED}

QUERIES = {name: query for name, (query, _) in _DEFINED.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _DEFINED.items() if sql}
