"""All queries of the library, gathered from the modules that declare them."""

from __future__ import annotations

from collections.abc import Callable

from factweir.plans import figure_queries, measure_queries, record_queries, run_queries, service_queries, text_queries, traffic_queries, web_queries

FLAGSHIP = "leaderboard"

_MODULES = (run_queries, traffic_queries, measure_queries, text_queries, figure_queries, record_queries, web_queries, service_queries)


def queries() -> dict[str, Callable]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
