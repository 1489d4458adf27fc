"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from passagework.llm.queries import QUERIES
from passagework.llm.sql import SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
