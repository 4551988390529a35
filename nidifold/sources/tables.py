"""Base tables and literals as vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import Vector

#: Declared candidate keys of the tables. A table is a list in the order of its shortest key.
KEYS: dict[str, list[tuple[str, ...]]] = {
    "region": [("r_regionkey",)],
    "nation": [("n_nationkey",)],
    "customer": [("c_custkey",)],
    "supplier": [("s_suppkey",)],
    "part": [("p_partkey",)],
    "orders": [("o_orderkey",)],
    "lineitem": [("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")],
    "events": [("event_id",)],
    "documents": [("doc_id",)],
    "conversations": [("conv_id", "turn")],
    "pages": [("page_id",)],
    "benchmark": [("item_id",)],
    "embeddings": [("vec_id",)],
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shortest_key(name: str) -> tuple[str, ...]:
    return min(KEYS[name], key=len)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Vector:
    """A table as one list, with the given columns (all by default)."""
    df = frame(spark, sf_dir, name)
    key = [F.col(c) for c in shortest_key(name)]
    return Vector.made(df, [], key, [(c, True) for c in key], [(c, F.col(c)) for c in columns or df.columns])


def as_list(df: DataFrame, key: Sequence[str], order: Sequence[str] | None = None) -> Vector:
    """Any DataFrame with a key as one list."""
    return Vector.made(df, [], [F.col(c) for c in key], [(F.col(c), True) for c in order or key], [(c, F.col(c)) for c in df.columns])


def literal(spark: SparkSession, rows: Sequence[tuple], schema: str) -> Vector:
    """A literal list."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_n long, {schema}")
    return Vector.made(df, [], [F.col("_n")], [(F.col("_n"), True)], [(c, F.col(c)) for c in df.columns[1:]])


def literal_deep(spark: SparkSession, values: Sequence[Sequence[Sequence[tuple]]], schema: str) -> tuple[Vector, Vector, Vector]:
    """A literal list of lists of lists: its three levels, the upper two without values. Lists of all levels may be empty."""
    outer, middle = literal_lists(spark, [[() for _ in lists] for lists in values], "")
    rows = [(k, j, i, *r) for k, lists in enumerate(values) for j, rows in enumerate(lists) for i, r in enumerate(rows)]
    inner = spark.createDataFrame(rows, f"_n long, _m long, _l long, {schema}")
    n, m, last = F.col("_n"), F.col("_m"), F.col("_l")
    return outer, middle, Vector.made(inner, [n, m], [n, m, last], [(last, True)], [(c, F.col(c)) for c in inner.columns[3:]])


def literal_lists(spark: SparkSession, lists: Sequence[Sequence[tuple]], schema: str) -> tuple[Vector, Vector]:
    """A literal list of lists: an outer vector without values, and the inner one. Inner lists may be empty."""
    outer = spark.createDataFrame([(k,) for k in range(len(lists))], "_n long")
    inner = spark.createDataFrame([(k, j, *r) for k, rows in enumerate(lists) for j, r in enumerate(rows)], ", ".join(["_n long", "_m long", *([schema] if schema else [])]))
    n, m = F.col("_n"), F.col("_m")
    return Vector.made(outer, [], [n], [(n, True)], []), Vector.made(inner, [n], [n, m], [(m, True)], [(c, F.col(c)) for c in inner.columns[2:]])
