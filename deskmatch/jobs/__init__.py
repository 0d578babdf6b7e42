"""Registered queries of the sales-matching jobs, with the SQL that must give the same rows."""

from __future__ import annotations

from . import desk, entities, mails, market, matching

MODULES = [market, matching, mails, entities, desk]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
