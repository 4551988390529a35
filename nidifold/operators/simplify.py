"""What declared keys make superfluous in groupings. Catalyst knows no functional dependencies, so this is done when plans
are made."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_by_key(df: DataFrame, columns: Sequence[str], aggregates: Sequence[Column], keys: Iterable[Collection[str]] = ()) -> DataFrame:
    """``groupBy(columns).agg(aggregates)``; columns that a key among them determines don't become part of the grouping."""
    key = min((k for k in keys if set(k) <= set(columns)), key=len, default=None)
    if key is None:
        return df.groupBy(*columns).agg(*aggregates)
    rest = [c for c in columns if c not in key]
    out = df.groupBy(*[c for c in columns if c in key]).agg(*[F.first(c).alias(c) for c in rest], *aggregates)
    return out.select(*columns, *[c for c in out.columns if c not in columns])
