"""Named queries of the graph engine and their SQL equivalents, gathered from the query modules."""

from __future__ import annotations

from graphloom.plans import code_queries, core_queries, more_queries, report_queries, store_queries

MODULES = (core_queries, more_queries, code_queries, report_queries, store_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
