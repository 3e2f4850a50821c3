"""Queries over the driver's tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("aggregates", "patterns", "graph", "ledger", "analytics", "records", "supply", "quads", "checks", "structures", "knowledge", "documents", "rules", "endpoints", "gates")


def _modules():
    return [import_module(f"quarry.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {name: f for m in _modules() for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, (_, sql) in m.QUERIES.items() if sql}
