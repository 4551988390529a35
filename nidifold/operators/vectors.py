"""Ordered, nested lists as DataFrames.

A vector holds all lists of one nesting level, a row for each element: ``_s*`` columns name the element's list (the key of
the element of the outer level that owns it; none at the top), ``_k*`` columns identify the element, ``_o*`` columns order it
in its list, and the other columns are its value. Keys are natural: those of inputs, side by side. Nothing is sorted before
the output; an operation that reorders a list changes only what its order columns hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows
from ..functions.aggregates import Aggregate
from .relational import LEFT, MATCH, RIGHT, Predicate, joined, sides


def _names(kind: str, n: int) -> list[str]:
    return [f"_{kind}{k}" for k in range(n)]


def _and(parts: Sequence[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, parts) if parts else None


@dataclass(frozen=True)
class Map:
    """Pairs of identifiers: rows or lists ``from`` become, or are copied to, ``to``."""

    frame: DataFrame
    n_from: int
    n_to: int


@dataclass(frozen=True)
class Vector:
    frame: DataFrame
    n_seg: int
    n_key: int
    ascending: tuple[bool, ...]
    items: tuple[str, ...]

    # Roles

    @property
    def seg(self) -> list[str]:
        return _names("s", self.n_seg)

    @property
    def key(self) -> list[str]:
        return _names("k", self.n_key)

    @property
    def ord(self) -> list[str]:
        return _names("o", len(self.ascending))

    def order(self, flip: bool = False, of: Callable[[str], Column] = F.col) -> list[Column]:
        return [of(c).asc() if a != flip else of(c).desc() for c, a in zip(self.ord, self.ascending, strict=True)]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.seg).orderBy(*self.order())

    @staticmethod
    def made(frame: DataFrame, seg: Sequence[Column], key: Sequence[Column], order: Sequence[tuple[Column, bool]], items: Sequence[tuple[str, Column]]) -> Vector:
        """A vector of the given role and value columns of ``frame``."""
        out = frame.select(
            *[c.alias(n) for c, n in zip(seg, _names("s", len(seg)), strict=True)],
            *[c.alias(n) for c, n in zip(key, _names("k", len(key)), strict=True)],
            *[c.alias(n) for (c, _), n in zip(order, _names("o", len(order)), strict=True)],
            *[c.alias(n) for n, c in items],
        )
        return Vector(out, len(seg), len(key), tuple(a for _, a in order), tuple(n for n, _ in items))

    def _roles(self, of: Callable[[str], Column] = F.col) -> tuple[list[Column], list[Column], list[tuple[Column, bool]], list[tuple[str, Column]]]:
        return [of(c) for c in self.seg], [of(c) for c in self.key], [(of(c), a) for c, a in zip(self.ord, self.ascending, strict=True)], [(c, of(c)) for c in self.items]

    # One list at a time

    def project(self, **items: Column) -> Vector:
        """map"""
        s, k, o, _ = self._roles()
        return Vector.made(self.frame, s, k, o, list(items.items()))

    def select(self, predicate: Column) -> Vector:
        """filter; see surviving()"""
        return replace(self, frame=self.frame.filter(predicate))

    def surviving(self) -> Map:
        """The keys that are left, for app_filter."""
        return Map(self.frame.select(*self.key), self.n_key, 0)

    def number(self, name: str = "pos") -> Vector:
        """Each element with its position in its list, from 1."""
        return replace(self, frame=self.frame.withColumn(name, F.row_number().over(self.window()).cast("long")), items=(*self.items, name))

    def take(self, n: int) -> Vector:
        """The first elements of each list. Of the one at the top each partition gives no more than n."""
        if not self.n_seg:
            return replace(self, frame=self.frame.orderBy(*self.order()).limit(n))
        place = "_place"
        return replace(self, frame=self.frame.withColumn(place, F.row_number().over(self.window())).filter(F.col(place) <= n).drop(place))

    def sort(self, *by: Column | tuple[Column, bool]) -> Vector:
        """Stable: the new order is (by, old order). A pair gives the direction."""
        s, k, o, i = self._roles()
        return Vector.made(self.frame, s, k, [b if isinstance(b, tuple) else (b, True) for b in by] + o, i)

    def reverse(self) -> Vector:
        return replace(self, ascending=tuple(not a for a in self.ascending))

    def unique(self) -> Vector:
        """nub: of equal elements of a list the first stays."""
        first = Window.partitionBy(*self.seg, *self.items).orderBy(*self.order())
        return replace(self, frame=self.frame.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first"))

    def window_function(self, name: str, function: str, e: Column | None = None, preceding: int | None = None) -> Vector:
        """A running (all elements up to this one) or sliding (``preceding`` elements and this one) aggregate of each list."""
        w = windows.all_preceding(self.window()) if preceding is None else windows.preceding(self.window(), preceding)
        return replace(self, frame=self.frame.withColumn(name, windows.over(function, e, w)), items=(*self.items, name))

    # Nesting

    def segment(self) -> Vector:
        """Each element becomes a list of its own."""
        s, k, o, i = self._roles()
        return Vector.made(self.frame, k, k, o, i)

    def unsegment(self) -> Vector:
        """All elements in one list."""
        s, k, o, i = self._roles()
        return Vector.made(self.frame, [], k, o, i)

    def group(self, **by: Column) -> tuple[Vector, Vector]:
        """groupWithKey: the distinct groups of each list in their order, and the elements in their groups in the old order."""
        names = list(by)
        flat = self.frame.select("*", *[c.alias(f"_g{j}") for j, c in enumerate(by.values())])
        g = [F.col(f"_g{j}") for j in range(len(names))]
        s, k, o, i = self._roles()
        inner = Vector.made(flat, s + g, k, o, i)
        groups = flat.select(*self.seg, *g).distinct()
        outer = Vector.made(groups, s, s + g, [(c, True) for c in g], list(zip(names, g, strict=True)))
        return outer, inner

    def group_aggregate(self, by: dict[str, Column], aggregates: Sequence[Aggregate]) -> Vector:
        """Groups and their aggregates, without the groups' elements."""
        flat = self.frame.groupBy(*self.seg, *[c.alias(n) for n, c in by.items()]).agg(*[a.column() for a in aggregates])
        s, g = [F.col(c) for c in self.seg], [F.col(n) for n in by]
        return Vector.made(flat, s, s + g, [(c, True) for c in g], [(n, F.col(n)) for n in [*by, *[a.name for a in aggregates]]])

    def fold(self, *aggregates: Aggregate) -> Vector:
        """The aggregates of each list that has elements, as lists of one; unbox_default() gives the others their values."""
        flat = self.frame.groupBy(*self.seg).agg(*[a.column() for a in aggregates])
        s = [F.col(c) for c in self.seg]
        return Vector.made(flat, s, s, [], [(a.name, F.col(a.name)) for a in aggregates])

    def aggregate_inner(self, inner: Vector, *aggregates: Aggregate) -> Vector:
        """Each element with the aggregates of its inner list, which may be empty."""
        return self.unbox_default(inner.fold(*aggregates), {a.name: a.default for a in aggregates})

    # Two vectors

    def _join(self, other: Vector, pairs: Sequence[tuple[str, str]], on: Predicate | None, how: str = "inner") -> DataFrame:
        """A join on pairs of columns, in which null equals null (as in groupings), and a predicate."""
        left, right = sides()
        parts = [left(a).eqNullSafe(right(b)) for a, b in pairs] + ([on(left, right)] if on else [])
        condition = _and(parts)
        return joined(self.frame, other.frame, None if condition is None else lambda _l, _r: condition, how)

    def _same_list(self, other: Vector) -> list[tuple[str, str]]:
        """Lists meet those of the same owner; a single list at the top meets all."""
        return list(zip(self.seg, other.seg, strict=True)) if self.n_seg == other.n_seg else []

    @staticmethod
    def _both(a: Sequence, b: Sequence) -> list:
        return [*a, *b]

    def _pair(self, flat: DataFrame, other: Vector, seg: Sequence[Column] | None = None) -> Vector:
        left, right = sides()
        ls, lk, lo, li = self._roles(left)
        _, rk, ro, ri = other._roles(right)
        taken = {n for n, _ in li}
        return Vector.made(flat, ls if seg is None else seg, lk + rk, lo + ro, li + [(n if n not in taken else f"{n}_2", c) for n, c in ri])

    def semi_join(self, other: Vector, on: Predicate) -> Vector:
        flat = self._join(other, self._same_list(other), on, "left_semi")
        return Vector.made(flat, *self._roles(sides()[0]))

    def anti_join(self, other: Vector, on: Predicate) -> Vector:
        flat = self._join(other, self._same_list(other), on, "left_anti")
        return Vector.made(flat, *self._roles(sides()[0]))

    def theta_join(self, other: Vector, on: Predicate) -> Vector:
        """Pairs that satisfy the predicate, by left, then right order."""
        return self._pair(self._join(other, self._same_list(other), on), other)

    def product(self, other: Vector) -> Vector:
        return self._pair(self._join(other, self._same_list(other), None), other)

    def nest_join(self, other: Vector, on: Predicate) -> Vector:
        """For each element the list of its partners: an inner vector of this one, holding pairs."""
        flat = self._join(other, self._same_list(other), on)
        # Within the list of one left element the left order is constant, so the right order is all of it.
        pairs = self._pair(flat, other, [sides()[0](c) for c in self.key])
        n = len(self.ascending)
        roles = [*pairs.seg, *pairs.key, *pairs.ord[n:], *pairs.items]
        names = [*pairs.seg, *pairs.key, *_names("o", len(pairs.ord) - n), *pairs.items]
        frame = pairs.frame.select(*[F.col(c).alias(x) for c, x in zip(roles, names, strict=True)])
        return Vector(frame, pairs.n_seg, pairs.n_key, pairs.ascending[n:], pairs.items)

    def group_join(self, other: Vector, on: Predicate | Sequence[tuple[str, str]], aggregates: Callable[[Callable[[str], Column], Callable[[str], Column]], Sequence[Aggregate]]) -> Vector:
        """Each element with aggregates over its partners, none lost; what an aggregate sees are partners only. With pairs of
        columns that must be equal, in place of a predicate, aggregates are over columns of ``other`` alone, and it is aggregated
        before the join, so no more than a row for each partition and key is shuffled."""
        if not callable(on):
            found = list(aggregates(F.col, F.col))
            lists = other.seg if self.n_seg == other.n_seg else []
            grouped = other.frame.groupBy(*lists, *[F.col(b).alias(f"_g{j}") for j, (_, b) in enumerate(on)]).agg(*[a.column() for a in found])
            right = Vector(grouped, len(lists), 0, (), tuple(a.name for a in found))
            left, right_ = sides()
            flat = joined(self.frame, right.frame, lambda l, r: _and([l(a).eqNullSafe(r(b)) for a, b in zip(self.seg if lists else [], lists, strict=True)] + [l(a) == r(f"_g{j}") for j, (a, _) in enumerate(on)]), "left")  # noqa: E741
            s, k, o, i = self._roles(left)
            values = [(a.name, right_(a.name) if a.default is None else F.coalesce(right_(a.name), F.lit(a.default))) for a in found]
            return Vector.made(flat, s, k, o, i + values)
        marked = replace(other, frame=other.frame.withColumn(MATCH, F.lit(True)))
        flat = self._join(marked, self._same_list(other), on, "left")
        found = list(aggregates(*sides()))
        hit = F.col(RIGHT + MATCH).isNotNull()
        rest = [c for c in self.frame.columns if c not in self.key]
        flat = flat.groupBy(*[LEFT + c for c in self.key]).agg(*[F.first(LEFT + c).alias(LEFT + c) for c in rest], *[a.column(hit) for a in found])
        s, k, o, i = self._roles(sides()[0])
        return Vector.made(flat, s, k, o, i + [(a.name, F.col(a.name)) for a in found])

    def align(self, other: Vector) -> Vector:
        """Element by element, for vectors with the same keys."""
        flat = self._join(other, list(zip(self.key, other.key, strict=True)), None)
        left, right = sides()
        s, k, o, i = self._roles(left)
        taken = {n for n, _ in i}
        return Vector.made(flat, s, k, o, i + [(n if n not in taken else f"{n}_2", right(n)) for n in other.items])

    def zip(self, other: Vector) -> Vector:
        """Pairs by position; the longer list's rest is left out."""
        a, b = self.number("_pos"), other.number("_pos")
        flat = a._join(b, [*self._same_list(other), ("_pos", "_pos")], None)
        left, right = sides()
        s, k, o, i = self._roles(left)
        taken = {n for n, _ in i}
        return Vector.made(flat, s, k, o, i + [(n if n not in taken else f"{n}_2", right(n)) for n in other.items])

    def append(self, other: Vector) -> Vector:
        """All of the left before the right. The branch is the first key and order column, so nothing is numbered."""
        width = max(self.n_key, other.n_key)
        kinds = [{f.name: f.dataType for f in v.frame.schema.fields} for v in (self, other)]
        # Orders of one direction and type share columns; others stand side by side, null in the other branch.
        n, m = len(self.ascending), len(other.ascending)
        short = min(n, m)
        shared = self.ascending[:short] == other.ascending[:short] and all(kinds[0][c] == kinds[1][c] for c in _names("o", short))
        directions = max(self.ascending, other.ascending, key=len) if shared else (*self.ascending, *other.ascending)

        def part(v: Vector, branch: int) -> DataFrame:
            s, k, o, i = v._roles()
            none = lambda kind: F.lit(None).cast(kind)
            other_kinds = kinds[2 - branch]
            keys = [F.lit(branch), *k, *[none(other_kinds[c]) for c in _names("k", width)[v.n_key :]]]
            own = [c for c, _ in o]
            if shared:
                orders = own + [none(other_kinds[c]) for c in _names("o", max(n, m))[len(own) :]]
            else:
                gaps = [none(other_kinds[c]) for c in _names("o", m if branch == 1 else n)]
                orders = own + gaps if branch == 1 else gaps + own
            orders = [F.lit(branch), *orders]
            return v.frame.select(*s, *[c.alias(f"_k{j}") for j, c in enumerate(keys)], *[c.alias(f"_o{j}") for j, c in enumerate(orders)], *[c for _, c in i])

        return Vector(part(self, 1).unionByName(part(other, 2)), self.n_seg, width + 1, (True, *directions), self.items)

    def combine(self, condition: str, then: Vector, otherwise: Vector) -> Vector:
        """Elements from ``then`` where the Boolean item holds, else from ``otherwise``; all three share keys."""
        def part(v: Vector, wanted: bool) -> DataFrame:
            picked = self.select(F.col(condition) if wanted else ~F.col(condition))
            flat = picked._join(v, list(zip(self.key, v.key, strict=True)), None)
            left, right = sides()
            s, k, o, _ = self._roles(left)
            return Vector.made(flat, s, k, o, [(n, right(n)) for n in then.items]).frame

        return replace(self, frame=part(then, True).unionByName(part(otherwise, False)), items=then.items)

    # An outer and an inner vector: the inner one's segments are the outer one's keys

    def _to_inner(self, inner: Vector) -> list[tuple[str, str]]:
        return list(zip(self.key, inner.seg, strict=True))

    def replicate_nest(self, inner: Vector) -> Vector:
        """Each inner element with the value of its owner."""
        flat = self._join(inner, self._to_inner(inner), None)
        left, right = sides()
        s, k, o, i = inner._roles(right)
        taken = {n for n, _ in i}
        return Vector.made(flat, s, k, o, [(n if n not in taken else f"{n}_outer", left(n)) for n in self.items] + i)

    def app_filter(self, inner: Vector) -> Vector:
        """The inner lists of the elements that are left."""
        frame = inner.frame.join(self.frame.select(*[F.col(c).alias(f"_f{j}") for j, c in enumerate(self.key)]), _and([F.col(f"_f{j}").eqNullSafe(F.col(c)) for j, c in enumerate(inner.seg)]), "left_semi")
        return replace(inner, frame=frame)

    def merge(self, inner: Vector) -> Vector:
        """concat: the inner elements, in their owners' lists, by (owner's order, own order)."""
        flat = self._join(inner, self._to_inner(inner), None)
        left, right = sides()
        s, _, o, _ = self._roles(left)
        _, k, o2, i = inner._roles(right)
        return Vector.made(flat, s, [*[left(c) for c in self.key], *k], o + o2, i)

    def unbox(self, inner: Vector) -> Vector:
        """Each element with the only element of its inner list."""
        flat = self._join(inner, self._to_inner(inner), None)
        left, right = sides()
        s, k, o, i = self._roles(left)
        return Vector.made(flat, s, k, o, i + [(n, right(n)) for n in inner.items])

    def unbox_default(self, inner: Vector, defaults: dict[str, object]) -> Vector:
        """The same, with values for empty inner lists. A flag tells them from lists that hold nulls."""
        marked = replace(inner, frame=inner.frame.withColumn(MATCH, F.lit(True)))
        flat = self._join(marked, self._to_inner(inner), None, "left")
        left, right = sides()
        s, k, o, i = self._roles(left)
        hit = right(MATCH).isNotNull()
        return Vector.made(flat, s, k, o, i + [(n, F.when(hit, right(n)).otherwise(F.lit(defaults.get(n)))) for n in inner.items])

    def replicate_vector(self, owners: Vector) -> Vector:
        """A copy of the whole list for each element of ``owners``."""
        flat = joined(self.frame, owners.frame.select(*owners.key), None)
        left, right = sides()
        _, k, o, i = self._roles(left)
        own = [right(c) for c in owners.key]
        return Vector.made(flat, own, own + k, o, i)

    def replicate_scalar(self, single: Vector) -> Vector:
        """Each element with the value of a list of one element. The planner sees whether it is small."""
        flat = joined(self.frame, single.frame.select(*single.items), None)
        left, right = sides()
        s, k, o, i = self._roles(left)
        return Vector.made(flat, s, k, o, i + [(n, right(n)) for n in single.items])

    # Maps

    def key_map(self) -> Map:
        """Keys to lists: where each element is."""
        frame = self.frame.select(*[F.col(c).alias(f"_f{j}") for j, c in enumerate(self.key)], *[F.col(c).alias(f"_t{j}") for j, c in enumerate(self.seg)])
        return Map(frame, self.n_key, self.n_seg)

    def unit_map(self) -> Map:
        """All keys to the single list at the top."""
        return Map(self.frame.select(*[F.col(c).alias(f"_f{j}") for j, c in enumerate(self.key)]), self.n_key, 0)

    def app_key(self, m: Map) -> Vector:
        """Lists renamed by a map."""
        return self._mapped(m, copies=False)

    def app_sort(self) -> Vector:
        """Nothing: with natural keys a sorted outer list needs no new names for its inner ones."""
        return self

    def app_rep(self, m: Map) -> Vector:
        """Lists copied to all that a map names for them; the copies' elements get keys of their own."""
        return self._mapped(m, copies=True)

    def _mapped(self, m: Map, copies: bool) -> Vector:
        flat = joined(m.frame, self.frame, lambda a, b: _and([a(f"_f{j}").eqNullSafe(b(c)) for j, c in enumerate(self.seg)]))
        left, right = sides()
        _, k, o, i = self._roles(right)
        to = [left(f"_t{j}") for j in range(m.n_to)]
        return Vector.made(flat, to, to + k if copies else k, o, i)

    def nest(self) -> tuple[DataFrame, Vector]:
        """A list of this one list: an outer row, and the elements in it."""
        s, k, o, i = self._roles()
        return self.frame.sparkSession.range(1).select(F.lit(0).alias("_k0")), Vector.made(self.frame, [F.lit(0)], k, o, i)


def composed(first: Map, then: Map) -> Map:
    """A map that follows one map with another."""
    flat = joined(first.frame, then.frame, lambda a, b: _and([a(f"_t{j}").eqNullSafe(b(f"_f{j}")) for j in range(first.n_to)]))
    left, right = sides()
    return Map(flat.select(*[left(f"_f{j}").alias(f"_f{j}") for j in range(first.n_from)], *[right(f"_t{j}").alias(f"_t{j}") for j in range(then.n_to)]), first.n_from, then.n_to)
