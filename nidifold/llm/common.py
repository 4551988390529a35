"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: blank, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset and all run in one process
    (tests), it is set to a new folder of this machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="nidifold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: After so many staged tables the driver's Python looks for what it no longer needs.
STAGED_TABLES = 8
_written: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()
_staged: WeakKeyDictionary[SparkSession, int] = WeakKeyDictionary()


def own_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, to be deleted by release()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark, []).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    This cuts the lineage: a later loss of executors re-reads files instead of recomputing, and what was computed once
    (row numbers, ids) stays as it is.
    """
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.parquet(path)
    _staged[spark] = _staged.get(spark, 0) + 1
    if _staged[spark] % STAGED_TABLES == 0:
        # Python's handles of JVM objects lie in cycles. Until these are found, which is seldom by itself, the driver's JVM
        # keeps the plans of all earlier steps, and what they broadcast.
        gc.collect()
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def release(spark: SparkSession) -> None:
    """Deletes the folders that operators have made for this session: staged tables, slot maps and token files without a path
    of the caller's. Results are lazy and read them, so this comes after results are written."""
    for path in _written.pop(spark, []):
        delete(spark, path)


@contextmanager
def last_kept(spark: SparkSession) -> Iterator[None]:
    """Of the tables that are staged in here only the last one stays: the others are deleted at the end, since what has been
    written is read back without them. Nothing else that reads them may be used after that."""
    before = len(_written.setdefault(spark, []))
    yield
    *passed, last = _written[spark][before:]
    for path in passed:
        delete(spark, path)
    _written[spark][before:] = [last]


def small_batches(spark: SparkSession) -> None:
    """Sends texts to Python in small batches, so that long ones need no more memory than a worker has, and lets workers find
    this package where it is not installed but lies at the same place. Both hold for the rest of the session, as its queries
    are lazy: the batch sizes where the session has none of its own, the path for workers that start from now on."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    for name, value in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def text_hash() -> Column:
    """Tells the texts of rows with the same doc_id, or none, from one another."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


#: A key counts as hot when it holds more than one row in this many. So there are fewer than this many hot keys: their hashes
#: may go to the driver, and a table with one row for each of them may be broadcast.
HOT_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Equi-join (nulls match nulls) with a ``right`` that has one row per key and the key's row count in ``count``.

    Rows with hot keys, told by the keys' hash, are joined by a broadcast and stay where they are; all others are shuffled.
    Both inputs are read twice: stage them first. ``count`` does not appear in the result.
    """
    values = [c for c in right.columns if c not in keys and c != count]
    as_right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *values, count)
    on = lambda: reduce(lambda a, b: a & b, [same(F.col(k), F.col(f"__{k}")) for k in keys])
    out = [*left.columns, *values]
    hot = list({r[0] for r in right.filter(F.col(count) * F.lit(HOT_SHARE) > F.lit(total)).select(F.xxhash64(*keys)).collect()})
    if not hot:
        return left.join(as_right, on(), how).select(*out)
    hot_left, hot_right = F.xxhash64(*keys).isin(hot), F.xxhash64(*[f"__{k}" for k in keys]).isin(hot)
    near = left.filter(hot_left).join(F.broadcast(as_right.filter(hot_right)), on(), how)
    far = left.filter(~hot_left).join(as_right.filter(~hot_right), on(), how)
    return near.select(*out).unionByName(far.select(*out))


#: Slots of the bitmap by which most rows are known not to be in a table of keys: 2 MB in 64-bit words, whatever the tables' sizes.
KEY_SLOTS = 1 << 24


def without(rows: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose ``keys`` are not among those in ``gone`` (staged; its columns in this order; nulls match nulls).

    Rows whose slot no key of ``gone`` has stay where they are; only the others are joined. So texts of rows that stay are
    hardly ever shuffled, also where ``gone`` is too large for a broadcast. Both inputs are read twice.
    """
    slot = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(KEY_SLOTS))
    bit = lambda s: F.expr(f"shiftleft(1L, cast({s} % 64 AS int))")
    taken = gone.select(slot(gone.columns).alias("s")).groupBy(F.floor(F.col("s") / 64).alias("__word")).agg(F.bit_or(bit("s")).alias("__bits"))
    marked = rows.withColumn("__slot", slot(keys)).withColumn("__at", F.floor(F.col("__slot") / 64))
    marked = marked.join(F.broadcast(taken), F.col("__at") == F.col("__word"), "left")
    likely = F.coalesce(F.col("__bits").bitwiseAND(bit("__slot")) != 0, F.lit(False))
    named = gone.toDF(*[f"__gone{k}" for k in range(len(keys))])
    on = reduce(lambda a, b: a & b, [same(key, F.col(f"__gone{k}")) for k, key in enumerate(keys)])
    stay, rest = (marked.filter(x).select(*rows.columns) for x in (~likely, likely))
    return stay.unionByName(rest.join(named, on, "left_anti"))
