"""All queries of the core and their SQL."""

from __future__ import annotations

from tallyspark.plans import case_queries, evaluation_queries, ingest_queries, ledger_queries, problems, scenario_queries

_MODULES = (ledger_queries, ingest_queries, case_queries, evaluation_queries, scenario_queries, problems)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
