"""Registered queries over the given tables."""

import importlib
import pkgutil

from catalog.registry import ORACLE, QUERIES, ROWS

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _module.endswith("_queries"):
        importlib.import_module(f"catalog.{_module}")

__all__ = ["ORACLE", "QUERIES", "ROWS"]
