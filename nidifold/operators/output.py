"""Results: one DataFrame with nested arrays, or a bundle with one flat, ordered DataFrame for each nesting level."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Vector


@dataclass(frozen=True)
class Nested:
    """A vector and the inner lists of its elements, by name."""

    vector: Vector
    children: dict[str, Nested] = field(default_factory=dict)


def _collected(v: Vector, extra: list[str]) -> DataFrame:
    """The lists of a vector as arrays: its segment columns and ``_list``."""
    placed = v.frame.withColumn("_place", F.row_number().over(v.window()))
    pairs = F.struct(F.col("_place").alias("p"), F.struct(*[F.col(c) for c in [*v.items, *extra]]).alias("v"))
    lists = placed.groupBy(*v.seg).agg(F.sort_array(F.collect_list(pairs)).alias("_list"))
    return lists.select(*v.seg, F.transform("_list", lambda x: x["v"]).alias("_list"))


def _with_children(tree: Nested) -> Vector:
    v = tree.vector
    frame = v.frame
    for name, child in tree.children.items():
        inner = _with_children(child)
        lists = _collected(inner, list(child.children)).select(*[F.col(c).alias(f"_c{j}") for j, c in enumerate(inner.seg)], F.col("_list").alias(name))
        on = [F.col(k).eqNullSafe(F.col(f"_c{j}")) for j, k in enumerate(v.key)]
        kind = lists.schema[name].dataType
        frame = frame.join(lists, on, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind))).drop(*[f"_c{j}" for j in range(inner.n_seg)])
    return Vector(frame, v.n_seg, v.n_key, v.ascending, v.items)


def to_nested(tree: Nested) -> DataFrame:
    """A row for each element of the top list, in order, its inner lists as arrays (empty ones too)."""
    v = _with_children(tree)
    return v.frame.orderBy(*v.order()).select(*v.items, *tree.children)


def to_bundle(tree: Nested) -> list[DataFrame]:
    """A DataFrame for each level, outer ones first, ordered by list and position. Keys are given only where something
    nests below, segments only where the level is nested itself."""
    v = tree.vector
    columns = [*v.seg, *(v.key if tree.children else []), *v.items]
    out = [v.frame.orderBy(*v.seg, *v.order()).select(*columns)]
    for child in tree.children.values():
        out += to_bundle(child)
    return out


def positions(v: Vector, name: str = "pos") -> DataFrame:
    """The values of a vector with their positions in their lists, without role columns; order is told by positions."""
    return v.number(name).frame.select(*v.items, name)
