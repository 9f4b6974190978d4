"""Queries of the llm problems and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from . import corpus_queries, graph_queries, text_queries

MODULES = [graph_queries, corpus_queries, text_queries]

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
