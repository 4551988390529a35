"""Functions over list positions, and their frames. Frames are always in rows: positions are a total order."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FUNCTIONS = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
    "all": F.bool_and,
    "any": F.bool_or,
    "first": F.first_value,
    "last": F.last_value,
}


def all_preceding(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def preceding(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(-n, Window.currentRow)


def over(function: str, e: Column | None, window: WindowSpec) -> Column:
    """``function`` over a window that has its frame; ``count`` takes no argument."""
    if function == "count":
        return F.count(F.lit(1)).over(window)
    return FUNCTIONS[function](e).over(window)
