"""Retail queries over the shared tables."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """The registered queries, and the SQL of those that have one."""
    from . import contracts, ingest, intake, marts, reports, rules, runs, stored  # noqa: F401
    from .registry import ORACLE_SQL, QUERIES

    return dict(QUERIES), dict(ORACLE_SQL)
