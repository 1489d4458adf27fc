"""All queries of the core with their SQL."""

from __future__ import annotations

from passagework.plans import access_queries, answer_queries, evaluation_queries, ingest_queries, retrieval_queries, snapshot_queries, text_queries

MODULES = [access_queries, answer_queries, evaluation_queries, ingest_queries, retrieval_queries, snapshot_queries, text_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
