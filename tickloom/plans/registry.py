"""All queries of the market part, and their SQL."""

from __future__ import annotations

from tickloom.plans import filters, further, market_queries, more_queries, more_sql, parameter_queries, recurrence_sql, screens, series_queries, setup_queries, sheet, stream_queries, swing_queries, warehouse_queries

PARTS = (series_queries, market_queries, screens, filters, sheet, more_queries, further, warehouse_queries, stream_queries, swing_queries, parameter_queries, setup_queries)


def queries() -> dict:
    return {n: q for part in PARTS for n, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for part in (*PARTS, more_sql, recurrence_sql) for n, s in part.SQL.items()}
