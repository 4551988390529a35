"""Operators on bags of rows, where Spark's own need care. The rest is select, filter, distinct, groupBy and join."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.aggregates import Aggregate

Predicate = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
LEFT, RIGHT, MATCH = "l__", "r__", "m__"


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def sides() -> tuple[Callable[[str], Column], Callable[[str], Column]]:
    return (lambda c: F.col(LEFT + c)), (lambda c: F.col(RIGHT + c))


def joined(left: DataFrame, right: DataFrame, on: Predicate | None, how: str = "inner") -> DataFrame:
    """A join of the columns of both sides, with prefixes. Without a predicate it is a product."""
    left, right = prefixed(left, LEFT), prefixed(right, RIGHT)
    if on is None:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    return left.join(right, on(*sides()), how)


def row_number(df: DataFrame, name: str, partition: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))


def rank(df: DataFrame, name: str, order: Sequence[Column | str], partition: Sequence[str] = (), dense: bool = False) -> DataFrame:
    function = F.dense_rank() if dense else F.rank()
    return df.withColumn(name, function.over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))


def grand_aggregate(df: DataFrame, aggregates: Sequence[Aggregate]) -> DataFrame:
    """One row, also for an empty input."""
    return df.agg(*[a.column() for a in aggregates])


def semi_join(left: DataFrame, right: DataFrame, on: Predicate) -> DataFrame:
    out = joined(left, right, on, "left_semi")
    return out.select(*[F.col(LEFT + c).alias(c) for c in left.columns])


def anti_join(left: DataFrame, right: DataFrame, on: Predicate) -> DataFrame:
    out = joined(left, right, on, "left_anti")
    return out.select(*[F.col(LEFT + c).alias(c) for c in left.columns])


def left_outer_default(left: DataFrame, right: DataFrame, on: Predicate, defaults: Mapping[str, object]) -> DataFrame:
    """A left outer join whose right columns (those of ``defaults``) have constants where there is no match. A flag, not
    the values, tells a match, so nulls on the right stay nulls."""
    out = joined(left, right.withColumn(MATCH, F.lit(True)), on, "left")
    hit = F.col(RIGHT + MATCH).isNotNull()
    return out.select(*[F.col(LEFT + c).alias(c) for c in left.columns], *[F.when(hit, F.col(RIGHT + c)).otherwise(F.lit(d)).alias(c) for c, d in defaults.items()])


def group_join(left: DataFrame, right: DataFrame, key: Sequence[str], on: Predicate, aggregates: Callable[[Callable[[str], Column], Callable[[str], Column]], Sequence[Aggregate]]) -> DataFrame:
    """For each row of ``left`` (identified by ``key``) aggregates over its matches. No left row is lost; aggregates see
    matches only, also where they are over left columns, and have their defaults without any."""
    out = joined(left, right.withColumn(MATCH, F.lit(True)), on, "left")
    hit = F.col(RIGHT + MATCH).isNotNull()
    rest = [c for c in left.columns if c not in key]
    grouped = out.groupBy(*[F.col(LEFT + c).alias(c) for c in key]).agg(*[F.first(LEFT + c).alias(c) for c in rest], *[a.column(hit) for a in aggregates(*sides())])
    return grouped.select(*left.columns, *[a.name for a in aggregates(*sides())])


def group_join_equi(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], aggregates: Sequence[Aggregate]) -> DataFrame:
    """The same for equality of columns and aggregates over right columns: the right side is aggregated before the join,
    so no more than a row per key is shuffled to it."""
    grouped = right.groupBy(*[F.col(r).alias(f"{RIGHT}{r}") for _, r in pairs]).agg(*[a.column() for a in aggregates])
    on = [F.col(a) == F.col(f"{RIGHT}{b}") for a, b in pairs]
    out = left.join(grouped, on, "left")
    return out.select(*[left[c] for c in left.columns], *[(F.col(a.name) if a.default is None else F.coalesce(F.col(a.name), F.lit(a.default))).alias(a.name) for a in aggregates])


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bag union, by column names."""
    return left.unionByName(right)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bag difference."""
    return left.exceptAll(right.select(*left.columns))


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
