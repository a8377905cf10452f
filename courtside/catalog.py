"""All queries of the library by name: importing it imports every module of plans, which register theirs."""
from __future__ import annotations

import importlib

from courtside.registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES", "query"]

for _name in ("reshape", "lookups", "aggregates", "ordered", "kernels", "statistics", "structures", "models", "live", "rally_log", "records", "pricing", "pages", "fitting", "rotation", "sources", "clutch"):
    importlib.import_module(f"courtside.plans.{_name}")
