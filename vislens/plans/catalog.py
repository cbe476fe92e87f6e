"""All registered queries and their reference SQL."""

from __future__ import annotations

import importlib

from vislens.plans.registry import ORACLE, QUERIES

MODULES = ("retrieval", "lifecycle", "cohort", "detector", "retrieval_log", "design", "compare", "quality", "rules", "streams", "extension")

for _name in MODULES:
    importlib.import_module(f"vislens.plans.{_name}")

__all__ = ["ORACLE", "QUERIES"]
