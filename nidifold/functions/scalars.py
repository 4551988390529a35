"""Scalar functions where Spark's own differ from what list queries mean, or need care. All others are plain Columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient, towards zero."""
    return F.call_function("div", a, b)


def similar_to(text: Column, pattern: str) -> Column:
    """SQL's SIMILAR TO: ``%`` and ``_`` are wildcards, the rest a regular expression that must match the whole text."""
    return text.rlike(similar_to_regex(pattern))


def similar_to_regex(pattern: str) -> str:
    out, in_class, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            out.append(re.escape(pattern[k + 1]))
            k += 1
        elif in_class:
            out.append("\\[" if c == "[" else c)
            in_class = c != "]"
        elif c == "[":
            out.append(c)
            in_class = True
        elif c in "%_":
            out.append(".*" if c == "%" else ".")
        elif c in ".^$":
            out.append("\\" + c)
        else:
            out.append(c)
        k += 1
    return "(?s)^(?:" + "".join(out) + r")\z"


def substring(text: Column, start: int, length: int) -> Column:
    """``length`` characters from position ``start``, counted from 1; what lies before the text counts as empty."""
    first = max(1, start)
    return F.substring(text, first, max(0, length - (first - start)))


def add_days(days: Column | int, date: Column) -> Column:
    """The offset comes first."""
    return F.date_add(date.cast("date"), days)


def sub_days(days: Column | int, date: Column) -> Column:
    return F.date_sub(date.cast("date"), days)


def diff_days(a: Column, b: Column) -> Column:
    """b - a in days."""
    return F.datediff(b.cast("date"), a.cast("date"))


def day(date: Column) -> Column:
    return F.dayofmonth(date).cast("long")


def month(date: Column) -> Column:
    return F.month(date).cast("long")


def year(date: Column) -> Column:
    return F.year(date).cast("long")


def log(x: Column) -> Column:
    """The natural logarithm."""
    return F.ln(x)


def to_double(x: Column) -> Column:
    return x.cast("double")


def to_decimal(x: Column, scale: int = 2, precision: int = 38) -> Column:
    return x.cast(f"decimal({precision},{scale})")


def tuple_(*parts: Column) -> Column:
    return F.struct(*[p.alias(f"_{k}") for k, p in enumerate(parts, 1)])


def tuple_eq(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Componentwise equality as a conjunction, so that each part can become a join key."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & (x == y)
    return out


def tuple_ne(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Tuples differ if any component does."""
    out = F.lit(False)
    for x, y in zip(a, b, strict=True):
        out = out | (x != y)
    return out


def if_(condition: Column, then: Sequence[Column] | Column, otherwise: Sequence[Column] | Column):
    """if/then/else; for tuples component by component."""
    if isinstance(then, Column):
        return F.when(condition, then).otherwise(otherwise)
    return [F.when(condition, a).otherwise(b) for a, b in zip(then, otherwise, strict=True)]
