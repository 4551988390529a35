"""Incremental aggregates of lists that grow, by Structured Streaming.

Lists on a stream have no end, so operators that need whole lists (sort, reverse, zip) don't apply. Filters and projections
are those of DataFrames. What remains is folding: running aggregates of each list, updated with each micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregate


def fold(stream: DataFrame, lists: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """For each list (named by columns) its aggregates so far; to be written in update or complete mode."""
    return stream.groupBy(*lists).agg(*[a.column() for a in aggregates])


def fold_by_time(stream: DataFrame, time: str, length: str, late: str, lists: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """The same for stretches of time, whose state is dropped once elements of it can come no more (``late``)."""
    marked = stream.withWatermark(time, late)
    return marked.groupBy(F.window(time, length), *lists).agg(*[a.column() for a in aggregates])
