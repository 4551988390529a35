"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from . import core, nested, tpch  # noqa: F401
from .common import ORACLE_SQL, QUERIES

FLAGSHIP = "top_orders_per_customer"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
