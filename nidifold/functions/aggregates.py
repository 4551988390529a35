"""Aggregates of lists, with the values that empty lists have."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    """``of(guard)`` is the aggregate over rows where ``guard`` holds; ``default`` what an empty list gives (None: null).

    The guard matters in group joins: without it an aggregate over columns of the outer side would count rows that have
    no partner.
    """

    name: str
    of: Callable[[Column | None], Column]
    default: object = None

    def column(self, guard: Column | None = None) -> Column:
        out = self.of(guard)
        return (out if self.default is None else F.coalesce(out, F.lit(self.default))).alias(self.name)


def _guarded(function: Callable[[Column], Column], e: Column) -> Callable[[Column | None], Column]:
    return lambda guard: function(e if guard is None else F.when(guard, e))


def sum_(name: str, e: Column) -> Aggregate:
    return Aggregate(name, _guarded(F.sum, e), 0)


def min_(name: str, e: Column) -> Aggregate:
    return Aggregate(name, _guarded(F.min, e))


def max_(name: str, e: Column) -> Aggregate:
    return Aggregate(name, _guarded(F.max, e))


def avg_(name: str, e: Column) -> Aggregate:
    return Aggregate(name, _guarded(F.avg, e))


def all_(name: str, e: Column) -> Aggregate:
    return Aggregate(name, _guarded(F.bool_and, e), True)


def any_(name: str, e: Column) -> Aggregate:
    return Aggregate(name, _guarded(F.bool_or, e), False)


def count_(name: str) -> Aggregate:
    return Aggregate(name, lambda guard: F.count(F.lit(1) if guard is None else F.when(guard, F.lit(1))), 0)


def count_distinct_(name: str, e: Column) -> Aggregate:
    return Aggregate(name, _guarded(F.count_distinct, e), 0)
