"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def money(c: Column | str) -> Column:
    """Doubles that hold cents, as decimals: their sums don't depend on the order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(14,2)")


def revenue(price: Column | None = None, discount: Column | None = None) -> Column:
    return money(price if price is not None else F.col("l_extendedprice")) * (F.lit(1).cast("decimal(14,2)") - money(discount if discount is not None else F.col("l_discount")))


#: The same in SQL.
SQL_REVENUE = "CAST(l_extendedprice AS DECIMAL(14,2)) * (CAST(1 AS DECIMAL(14,2)) - CAST(l_discount AS DECIMAL(14,2)))"


def double(c: Column) -> Column:
    return c.cast("double")
