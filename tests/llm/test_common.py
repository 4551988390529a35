"""The join for keys of which a few may be hot, and what else the operators share."""

import gc
import weakref
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nidifold.llm.common import STAGED_TABLES, join_counted, release, shared_dir, small_batches, staged, without


@pytest.mark.parametrize("total", [1, 3_000, 10**9])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_counted(spark, total, how):
    rows = [(k, None if k % 3 == 0 else "hot" if k % 3 == 1 else f"k{k % 50}") for k in range(600)]
    left = staged(spark.createDataFrame(rows, "i long, key string"), "left")
    right = left.groupBy("key").count().filter("coalesce(key, '') <> 'k2'").withColumnRenamed("count", "n").selectExpr("key", "n", "n * 2 as twice")
    got = join_counted(left, staged(right, "right"), ["key"], "n", total, how)
    count = Counter(k for _, k in rows)
    want = [(i, k, None if k == "k2" else 2 * count[k]) for i, k in rows if how == "left" or k != "k2"]
    assert got.columns == ["i", "key", "twice"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want


def test_settings_of_the_session_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 77)
    small_batches(spark)
    assert spark.conf.get(name) == "77"
    spark.conf.unset(name)
    small_batches(spark)
    assert spark.conf.get(name) == "2000"


def test_no_local_folder_on_a_cluster():
    class Cluster:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Cluster())


def test_release_is_by_session(spark):
    other = spark.newSession()
    ours, theirs = staged(spark.range(3), "ours"), staged(other.range(4), "theirs")
    release(other)
    assert ours.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|FILE_NOT_FOUND|does not exist"):
        theirs.count()


def test_staging_lets_old_plans_go(spark):
    release(spark)
    gc.collect()
    gc.disable()
    try:
        df = staged(spark.range(3).toDF("x"), "old")
        df.count()
        handle = weakref.ref(df._jdf)
        df = staged(df, "next")
        for k in range(STAGED_TABLES):
            df = staged(df, f"later-{k}")
        assert handle() is None and df.count() == 3
    finally:
        gc.enable()


def test_without_shuffles_only_rows_that_may_be_gone(spark):
    gone = staged(spark.createDataFrame([(k, "x") for k in range(0, 4000, 2)] + [(None, "x"), (1, None)], "a long, b string"), "gone")
    rows = spark.createDataFrame([*[(k, "x", "text") for k in range(4000)], (None, "x", "text"), (None, None, "text"), (1, None, "text")], "a long, b string, text string")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = without(rows, [F.col("a"), F.col("b")], gone)
        got = out.collect()
        shuffled = [int(r) for r in written_to_shuffles(out)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert out.columns == rows.columns
    assert {(r.a, r.b) for r in got} == {(k, "x") for k in range(1, 4000, 2)} | {(None, None)} and len(got) == 2001
    assert max(shuffled) < 2100  # the 2002 rows that are gone, and few others
    empty = gone.limit(0)
    assert without(rows, [F.col("a"), F.col("b")], empty).count() == rows.count()


def written_to_shuffles(df):
    """Rows written by each shuffle of a query that has run."""
    nodes, out = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return out
