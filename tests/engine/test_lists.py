"""List semantics on small literals and on random nested lists, against plain Python lists."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nidifold.functions import aggregates as agg
from nidifold.functions import scalars as sc
from nidifold.operators import relational as rel
from nidifold.operators.output import Nested, to_bundle, to_nested
from nidifold.operators.simplify import group_by_key
from nidifold.operators.vectors import composed
from nidifold.sources.tables import literal, literal_lists

RANDOM = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
LISTS = st.lists(st.lists(st.integers(-3, 3), max_size=5), min_size=1, max_size=5)


def lists_of(spark, values):
    return literal_lists(spark, [[(x,) for x in row] for row in values], "x long")


def nested(outer, inner, *items):
    """The inner lists of all outer elements, in order."""
    tree = Nested(outer, {"inner": Nested(inner)})
    take = (lambda r: r[items[0]]) if len(items) == 1 else (lambda r: tuple(r[i] for i in items))
    return [[take(r) for r in row.inner] for row in to_nested(tree).collect()]


@RANDOM
@given(LISTS)
def test_one_list_operators(spark, values):
    outer, inner = lists_of(spark, values)
    assert nested(outer, inner, "x") == values
    assert nested(outer, inner.reverse(), "x") == [row[::-1] for row in values]
    assert nested(outer, inner.unique(), "x") == [list(dict.fromkeys(row)) for row in values]
    assert nested(outer, inner.sort(F.col("x") % 2), "x") == [sorted(row, key=lambda x: x % 2 if x >= 0 else -(-x % 2)) for row in values]
    assert nested(outer, inner.sort((F.col("x"), False)), "x") == [sorted(row, key=lambda x: -x) for row in values]
    assert nested(outer, inner.take(2), "x") == [row[:2] for row in values]
    assert nested(outer, inner.select(F.col("x") > 0), "x") == [[x for x in row if x > 0] for row in values]
    assert nested(outer, inner.number(), "x", "pos") == [[(x, k) for k, x in enumerate(row, 1)] for row in values]
    running = inner.window_function("s", "sum", F.col("x")).window_function("m", "max", F.col("x"), 1)
    assert nested(outer, running, "s", "m") == [[(sum(row[: k + 1]), max(row[max(0, k - 1) : k + 1])) for k in range(len(row))] for row in values]


@RANDOM
@given(LISTS, LISTS)
def test_two_list_operators(spark, a, b):
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    outer, left = lists_of(spark, a)
    _, right = lists_of(spark, b)
    assert nested(outer, left.zip(right), "x", "x_2") == [list(zip(p, q, strict=False)) for p, q in zip(a, b, strict=True)]
    assert nested(outer, left.append(right), "x") == [p + q for p, q in zip(a, b, strict=True)]
    assert nested(outer, left.append(right.reverse()), "x") == [p + q[::-1] for p, q in zip(a, b, strict=True)]
    less = lambda l, r: l("x") < r("x")  # noqa: E731,E741
    assert nested(outer, left.theta_join(right, less), "x", "x_2") == [[(x, y) for x in p for y in q if x < y] for p, q in zip(a, b, strict=True)]
    assert nested(outer, left.product(right), "x", "x_2") == [[(x, y) for x in p for y in q] for p, q in zip(a, b, strict=True)]
    assert nested(outer, left.semi_join(right, less), "x") == [[x for x in p if any(x < y for y in q)] for p, q in zip(a, b, strict=True)]
    assert nested(outer, left.anti_join(right, less), "x") == [[x for x in p if not any(x < y for y in q)] for p, q in zip(a, b, strict=True)]


@RANDOM
@given(LISTS)
def test_nesting_operators(spark, values):
    outer, inner = lists_of(spark, values)
    named = outer.project(k=F.col("_k0"))
    flat = [(k, x) for k, row in enumerate(values) for x in row]
    top = lambda v, *items: [tuple(r[i] for i in items) for r in v.frame.orderBy(*v.order()).collect()]
    assert top(named.merge(inner), "x") == [(x,) for _, x in flat]
    assert nested(outer, named.replicate_nest(inner), "k", "x") == [[(k, x) for x in row] for k, row in enumerate(values)]
    got = named.aggregate_inner(inner, agg.sum_("s", F.col("x")), agg.count_("n"), agg.all_("al", F.col("x") > 0), agg.any_("an", F.col("x") > 0), agg.max_("m", F.col("x")))
    assert top(got, "k", "s", "n", "al", "an", "m") == [(k, sum(r), len(r), all(x > 0 for x in r), any(x > 0 for x in r), max(r, default=None)) for k, r in enumerate(values)]
    even = named.select(F.col("k") % 2 == 0)
    assert nested(even, even.app_filter(inner), "x") == values[::2]
    groups, members = inner.group(g=F.abs("x"))
    want = [[(g, [x for x in row if abs(x) == g]) for g in sorted({abs(x) for x in row})] for row in values]
    tree = Nested(outer, {"groups": Nested(groups, {"members": Nested(members)})})
    assert [[(g.g, [m.x for m in g.members]) for g in row.groups] for row in to_nested(tree).collect()] == want
    tags = outer.project(t=F.col("_k0") * 10)
    assert top(outer.project(k=F.col("_k0")).align(tags), "k", "t") == [(k, 10 * k) for k in range(len(values))]
    copies = inner.app_rep(_doubled(outer))
    assert sorted((r._s0, r.x) for r in copies.frame.collect()) == sorted((100 * c + k, x) for k, x in flat for c in (1, 2))


def _doubled(outer):
    from nidifold.operators.vectors import Map

    frame = outer.frame.select(F.col("_k0").alias("_f0"), F.explode(F.array(F.col("_k0") + 100, F.col("_k0") + 200)).alias("_t0"))
    return Map(frame, 1, 1)


def test_maps(spark):
    outer, inner = lists_of(spark, [[1], [2, 3]])
    renamed = inner.app_key(_doubled(outer))
    assert {r._s0 for r in renamed.frame.collect()} == {100, 101, 200, 201}
    both = composed(inner.key_map(), _doubled(outer))
    assert both.frame.count() == 6 and both.n_from == 2 and both.n_to == 1
    assert inner.unit_map().frame.count() == 3 and inner.select(F.col("x") > 1).surviving().frame.count() == 2
    assert inner.unsegment().n_seg == 0 and inner.segment().n_seg == inner.n_key
    row, one = inner.unsegment().nest()
    assert row.count() == 1 and one.frame.filter("_s0 = 0").count() == 3
    assert [r.x for r in literal(spark, [(1,), (2,)], "x long").replicate_vector(outer).frame.collect()].count(1) == 2


def test_nested_ints_keep_empty_lists(spark):
    values = [[], [[]], [[], [1]], [[2, 3], []]]
    outer, middle = literal_lists(spark, [[(0,) for _ in row] for row in values], "d long")
    frame = spark.createDataFrame([(k, j, p, x) for k, row in enumerate(values) for j, r in enumerate(row) for p, x in enumerate(r)], "a long, b long, c long, x long")
    from nidifold.operators.vectors import Vector

    inner = Vector.made(frame, [F.col("a"), F.col("b")], [F.col("a"), F.col("b"), F.col("c")], [(F.col("c"), True)], [("x", F.col("x"))])
    tree = Nested(outer, {"m": Nested(middle, {"i": Nested(inner)})})
    assert [[[e.x for e in m.i] for m in row.m] for row in to_nested(tree).collect()] == values
    bundle = to_bundle(tree)
    assert len(bundle) == 3 and [b.count() for b in bundle] == [4, 5, 3]
    assert bundle[0].columns == ["_k0"] and bundle[2].columns == ["_s0", "_s1", "x"]


def test_combine_and_scalar(spark):
    v = literal(spark, [(1, True), (2, False), (3, True)], "x long, b boolean")
    out = v.combine("b", v.project(y=F.col("x") * 10), v.project(y=-F.col("x")))
    assert [r.y for r in out.frame.orderBy("_o0").collect()] == [10, -2, 30]
    m = v.replicate_scalar(v.fold(agg.max_("m", F.col("x"))))
    assert {r.m for r in m.frame.collect()} == {3}


def test_group_join_guards(spark):
    left = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    right = spark.createDataFrame([(1, None), (1, 5)], "k long, w long")
    on = lambda l, r: l("k") == r("k")  # noqa: E731,E741
    got = rel.group_join(left, right, ["k"], on, lambda l, r: [agg.sum_("s", l("v")), agg.count_("n"), agg.count_distinct_("d", r("w")), agg.avg_("a", l("v"))])  # noqa: E741
    assert sorted(map(tuple, got.collect())) == [(1, 10, 20, 2, 1, 10.0), (2, 20, 0, 0, 0, None)]
    equi = rel.group_join_equi(left, right, [("k", "k")], [agg.sum_("s", F.col("w")), agg.count_("n")])
    assert sorted(map(tuple, equi.collect())) == [(1, 10, 5, 2), (2, 20, 0, 0)]
    outer = rel.left_outer_default(left, right, on, {"w": -1})
    assert sorted(map(str, map(tuple, outer.collect()))) == ["(1, 10, 5)", "(1, 10, None)", "(2, 20, -1)"]
    empty = rel.left_outer_default(left, right.limit(0), lambda l, r: F.lit(True), {"w": 0})  # noqa: E741
    assert empty.count() == 2
    assert sorted(map(tuple, rel.anti_join(left, right, on).collect())) == [(2, 20)]


@RANDOM
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 2))), min_size=1, max_size=8))
def test_null_groups_keep_their_members(spark, rows):
    """At every level of nesting."""
    v = literal(spark, rows, "x long, g long")
    groups, members = v.group(g=F.col("g"))
    deeper, last = members.group(h=F.col("g"))
    tree = Nested(groups, {"deeper": Nested(deeper, {"members": Nested(last)})})
    got = {r.g: [[m.x for m in d.members] for d in r.deeper] for r in to_nested(tree).collect()}
    assert got == {g: [[x for x, h in rows if h == g]] for g in {g for _, g in rows}}
    assert sorted(r.x for r in groups.merge(members).frame.collect()) == sorted(x for x, _ in rows)
    assert groups.replicate_nest(members).frame.count() == groups.app_filter(members).frame.count() == len(rows)
    counted = groups.aggregate_inner(members, agg.count_("n"))
    assert {r.g: r.n for r in counted.frame.collect()} == {g: sum(h == g for _, h in rows) for g in {g for _, g in rows}}


def test_group_join_on_pairs(spark):
    outer, left = lists_of(spark, [[1, 2], [], [2, 3]])
    _, right = lists_of(spark, [[2, 2], [1], [3, 4]])
    found = lambda _, r: [agg.count_("n"), agg.max_("m", r("x"))]
    assert nested(outer, left.group_join(right, [("x", "x")], found), "x", "n", "m") == [[(1, 0, None), (2, 2, 2)], [], [(2, 0, None), (3, 1, 3)]]


def test_tuples_differ_in_any_part(spark):
    df = spark.createDataFrame([(1, 2, 1, 2), (1, 2, 1, 3), (1, 2, 4, 2)], "a long, b long, c long, d long")
    ne = sc.tuple_ne([F.col("a"), F.col("b")], [F.col("c"), F.col("d")])
    assert [r[0] for r in df.select(ne).collect()] == [False, True, True]
    assert [r[0] for r in df.select(sc.tuple_eq([F.col("a"), F.col("b")], [F.col("c"), F.col("d")])).collect()] == [True, False, False]


@pytest.mark.parametrize(("pattern", "text", "hit"), [("ab%", "abc", True), ("ab_", "ab", False), ("(a|b)+", "abba", True), ("a.c", "abc", False), ("a.c", "a.c", True), ("[a-c]%", "bx\ny", True), ("%b", "abc", False), (r"a\%", "a%", True), (r"a\%", "ab", False), ("abc", "abc\n", False), ("abc%", "abc\n", True)])
def test_similar_to(pattern, text, hit):
    assert bool(re.search(sc.similar_to_regex(pattern).replace(r"\z", r"\Z"), text)) == hit


def test_scalars(spark):
    row = spark.range(1).select(
        sc.int_div(F.lit(-7), F.lit(2)).alias("d"), (F.lit(-7) % 3).alias("m"), sc.substring(F.lit("hello"), 2, 3).alias("s"), sc.substring(F.lit("hello"), 0, 3).alias("z"),
        sc.diff_days(F.lit("2020-01-03"), F.lit("2020-01-10")).alias("n"), sc.add_days(3, F.lit("2020-01-30")).cast("string").alias("a"), sc.log(F.exp(F.lit(2.0))).alias("l"), sc.tuple_(F.lit(1), F.lit("x")).alias("t"),
    ).collect()[0]
    assert (row.d, row.m, row.s, row.z, row.n, row.a, round(row.l, 9), tuple(row.t)) == (-3, -1, "ell", "he", 7, "2020-02-02", 2.0, (1, "x"))


def test_simplifications(spark):
    df = spark.createDataFrame([(1, "x", 5), (1, "x", 6), (2, "y", 7)], "k long, n string, v long")
    out = group_by_key(df, ["n", "k"], [F.sum("v").alias("s")], [("k",)])
    assert out.columns == ["n", "k", "s"] and sorted(map(tuple, out.collect())) == [("x", 1, 11), ("y", 2, 7)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [k#" in plan
    assert group_by_key(df, ["n"], [F.count(F.lit(1)).alias("c")], [("k",)]).count() == 2
    assert rel.rank(df, "r", ["n"]).count() == 3 and rel.literal_rows(spark, [(1,)], "x long").count() == 1
    assert rel.difference(df, df.limit(0)).count() == 3
