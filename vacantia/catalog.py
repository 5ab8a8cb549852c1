"""All queries of the job-market engine by name."""

from __future__ import annotations

from vacantia.plans import audit_queries, discovery_queries, document_queries, function_queries, ingest_queries, landed_queries, market_queries, payload_queries, policy_queries, posted_queries, rule_queries, search_queries, source_queries, state_queries, table_queries, text_queries, tick_queries  # noqa: F401
from vacantia.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
