"""All registered queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidegate.plans import audit_queries, builder_queries, event_queries, evidence_queries, inference_queries, more_queries, source_queries, statistic_queries, stream_queries

FLAGSHIP = "ao_gate_matrix"


def queries() -> dict:
    return event_queries.QUERIES | statistic_queries.QUERIES | more_queries.QUERIES | builder_queries.QUERIES | evidence_queries.QUERIES | audit_queries.QUERIES | inference_queries.QUERIES | source_queries.QUERIES | stream_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return event_queries.SQL | statistic_queries.SQL | more_queries.SQL | builder_queries.SQL | evidence_queries.SQL | audit_queries.SQL | inference_queries.SQL | source_queries.SQL | stream_queries.SQL
