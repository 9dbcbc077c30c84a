"""Every query of the library by name, with its DuckDB counterpart."""

from __future__ import annotations

from terralift.plans import assignment_queries, estimator_queries, extra_queries, method_queries, panel_queries, portfolio_queries, store_queries

MODULES = (panel_queries, assignment_queries, estimator_queries, portfolio_queries, extra_queries, method_queries, store_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
FLAGSHIP = "did_two_by_two"
