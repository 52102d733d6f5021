"""All queries of the engine, by name, and their SQL."""

from __future__ import annotations

from .plans.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
