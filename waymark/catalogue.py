"""Registry of the library's own queries and their oracles."""

from __future__ import annotations

import importlib
import pkgutil

from waymark import catalogue_parts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in pkgutil.iter_modules(catalogue_parts.__path__):
    _module = importlib.import_module(f"waymark.catalogue_parts.{_part.name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
