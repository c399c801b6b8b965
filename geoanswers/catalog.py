"""Every query of the analytics operators and its SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib

#: Modules of geoanswers.plans; each has QUERIES and ORACLES.
MODULES: list[str] = ["attributes", "spatial", "shapes", "fields", "logs"]


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"geoanswers.plans.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
