"""Nested-list analytics on Spark: ordered, arbitrarily nested lists as DataFrames with segment, key, order and payload."""

from .operators.vectors import Vector
from .sources.tables import KEYS, literal, table

__all__ = ["KEYS", "Vector", "literal", "table"]
