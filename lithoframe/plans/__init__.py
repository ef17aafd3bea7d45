"""Registered queries and the SQL that each is compared with."""

from __future__ import annotations

from lithoframe.plans import analytics, decisions, documents, more, packages, payloads, rules

MODULES = [rules, decisions, analytics, documents, more, payloads, packages]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
