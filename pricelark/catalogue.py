"""All registered queries of the engine, by name, with their SQL."""

from __future__ import annotations

from .plans import catalog_queries, market_queries, report_queries, source_queries, stream_queries


def queries() -> dict:
    return catalog_queries.QUERIES | market_queries.QUERIES | report_queries.QUERIES | source_queries.QUERIES | stream_queries.QUERIES


def oracle_sql() -> dict:
    return catalog_queries.SQL | market_queries.SQL | report_queries.SQL | source_queries.SQL | stream_queries.SQL
