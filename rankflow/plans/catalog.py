"""Registry of the reference-shaped queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["swiss", "relational", "sequences", "text", "analysis", "streams", "tables"]


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"rankflow.plans.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
