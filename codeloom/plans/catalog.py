"""All queries over the reference operators."""

from __future__ import annotations

from codeloom.plans import evidence_queries, graph_queries, ledger_queries, package_queries, read_queries, review_queries, source_queries  # noqa: F401  (they register)
from codeloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
