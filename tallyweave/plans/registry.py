"""All queries of the engine by name, with SQL for an engine that has the base tables as views."""

from __future__ import annotations

from ..sources.fixtures import portable
from .reconcile import ORACLE, QUERIES
from .views import DERIVED

ORACLE_SQL: dict[str, str] = {name: portable(sql, DERIVED) for name, sql in ORACLE.items()}

__all__ = ["ORACLE_SQL", "QUERIES"]
