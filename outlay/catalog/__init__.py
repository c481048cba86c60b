"""Query catalogue: each entry binds an operator to the stored tables."""

from __future__ import annotations

import importlib

FAMILIES = ("billing", "primitives", "inventory", "detectors", "metrics", "dashboards", "streams", "series")


def all_queries() -> dict:
    out = {}
    for family in FAMILIES:
        out.update(importlib.import_module(f"outlay.catalog.{family}").QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    out = {}
    for family in FAMILIES:
        out.update(importlib.import_module(f"outlay.oracle.{family}").ORACLE)
    return out
