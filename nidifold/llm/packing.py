"""Best-fit packing of documents into token sequences by a linear grouping scheme.

Where a piece goes depends on its length only, so the plan is made from the histogram of lengths (at most one row per
possible length) and says for each length which ranks go where. The rows themselves never leave the executors: each piece
gets its rank among the pieces of its length and finds its place by a broadcast join with the plan, whose size depends on
the sequence length and the number of groups, not on the number of documents.

The plan: lengths over a fraction of the sequence are large. They are dealt, longest first, into groups of equal
cardinality and rounded up to the longest of their group; for these few sizes a linear program over configurations (column
generation, the new columns from a knapsack) says how often to use each configuration. Actual pieces then take the places
of their group, longest first, and what remains, small ones above all, goes by decreasing length to the fullest sequence
in which it fits.

Defined cases: a null text is an empty one, which is the end id alone; a null or repeated doc_id is packed like any other
row; equal rows are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import small_batches, staged
from .tokens import crc_of_ids, encoder, with_end

PIECE = "piece int, start long, length long, ids_crc32 long"
PLAN = T.StructType([T.StructField(x, T.LongType(), False) for x in ("length", "first_rank", "n", "sequence_id", "offset")])


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    Only documents of more than ``capacity`` ids are cut; all pieces but the first then have ``capacity`` ids.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids, sizes = with_end(*enc.encode(batch.column("text")), end_id)
                pieces = -(-sizes // capacity)
                first = sizes - capacity * (pieces - 1)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(piece == 0, 0, first[row] + capacity * (piece - 1))
                length = np.where(piece == 0, first[row], capacity)
                begin = (np.cumsum(sizes) - sizes)[row] + start
                parts = [ids[b : b + n] for b, n in zip(begin, length, strict=True)]
                columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([crc_of_ids(x) for x in parts], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, {PIECE}" + ", ids array<int>" * with_ids)


def grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) pairs, longest first, dealt into groups of equal cardinality; a length may fall into two of them."""
    total = sum(n for _, n in lengths)
    out: list[list[tuple[int, int]]] = []
    done = 0
    for k in range(groups):
        want = total * (k + 1) // groups - done
        group = []
        while want > 0 and lengths:
            size, n = lengths[0]
            took = min(n, want)
            group.append((size, took))
            want, done = want - took, done + took
            lengths = ([(size, n - took)] if n > took else []) + lengths[1:]
        if group and out and out[-1][0][0] == group[0][0]:
            out[-1] += group
        elif group:
            out.append(group)
    return out


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits (a knapsack in which each size may come again)."""
    best, took = np.zeros(capacity + 1), []
    while len(took) * int(sizes.min()) <= capacity:
        reach = np.full((len(sizes), capacity + 1), -1.0)
        for k, size in enumerate(sizes):
            reach[k, size:] = best[: capacity + 1 - size] + worth[k]
        choice = reach.argmax(axis=0)
        value = np.take_along_axis(reach, choice[None], axis=0)[0]
        better = value > best + 1e-12
        if not better.any():
            break
        took.append(np.where(better, choice, -1))
        best = np.where(better, value, best)
    config, left = np.zeros(len(sizes)), capacity
    for choice in reversed(took):
        if (k := choice[left]) >= 0:
            config[k] += 1
            left -= sizes[k]
    return float(config @ worth), config


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """How often to use which configuration of sizes, rounded down, from the linear program that needs fewest sequences."""
    size, need = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag((capacity // size).astype(float))
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(size)))
        value, new = best_configuration(size, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        amount, change = np.linalg.solve(basis, np.column_stack([need, new])).T
        limits = np.where(change > 1e-9, np.maximum(amount, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(limits.argmin())] = new
    amount = np.floor(np.linalg.solve(basis, need) + 1e-7).astype(int)
    return [(basis[:, k].astype(int), int(n)) for k, n in enumerate(amount) if n > 0]


class Sequences:
    """Sequences by what is free in them, as runs (first, n) of neighbours that are filled alike."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.plan = capacity, 0, []
        self.free: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []
        self.ranks: dict[int, int] = {}

    def opened(self, n: int) -> tuple[int, int]:
        run = (self.count, n)
        self.count += n
        return run

    def keep(self, free: int, run: tuple[int, int]) -> None:
        if free not in self.free:
            self.free[free] = []
            insort(self.sizes, free)
        self.free[free].append(run)

    def put(self, length: int, run: tuple[int, int], free: int) -> None:
        rank = self.ranks.get(length, 0)
        self.plan.append((length, rank, run[1], run[0], self.capacity - free))
        self.ranks[length] = rank + run[1]

    def best_fit(self, length: int, n: int) -> None:
        while n:
            k = bisect_left(self.sizes, length)
            if k == len(self.sizes):
                self.keep(self.capacity, self.opened(max(1, n // (self.capacity // length))))
                continue
            free = self.sizes[k]
            first, m = self.free[free].pop()
            if not self.free[free]:
                del self.free[free], self.sizes[k]
            took = min(m, n)
            if took < m:
                self.keep(free, (first + took, m - took))
            self.put(length, (first, took), free)
            if free > length:
                self.keep(free - length, (first, took))
            n -= took

    def fill(self, config: list[int], n: int, groups: list[list[tuple[int, int]]]) -> None:
        """``n`` new sequences, each with the places of ``config`` (numbers of groups) taken by the groups' longest pieces."""
        runs = [(self.opened(n), self.capacity)]
        for g in config:
            then = []
            for (first, m), free in runs:
                while m:
                    length, there = groups[g][0]
                    took = min(m, there)
                    groups[g][:1] = [(length, there - took)] if there > took else []
                    self.put(length, (first, took), free)
                    then.append(((first, took), free - length))
                    first, m = first + took, m - took
            runs = then
        for run, free in runs:
            if free:
                self.keep(free, run)


def packing_plan(histogram: dict[int, int], capacity: int = 1024, groups: int = 64, small: float = 1 / 8) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, number, first sequence, offset) that place all pieces, and the number of sequences."""
    out = Sequences(capacity)
    if histogram.get(capacity):
        out.put(capacity, out.opened(histogram[capacity]), capacity)
    descending = sorted(((size, n) for size, n in histogram.items() if size < capacity and n), reverse=True)
    large = [x for x in descending if x[0] > capacity * small]
    left: dict[int, int] = dict(x for x in descending if x[0] <= capacity * small)
    if large:
        dealt = grouped(large, groups)
        for config, n in configurations([g[0][0] for g in dealt], [sum(m for _, m in g) for g in dealt], capacity):
            there = [sum(m for _, m in g) for g in dealt]
            n = min([n, *(have // int(c) for have, c in zip(there, config, strict=True) if c)])
            if n:
                out.fill([g for g, c in enumerate(config) for _ in range(int(c))], n, dealt)
        for group in dealt:
            for size, m in group:
                left[size] = left.get(size, 0) + m
    for size in sorted(left, reverse=True):
        out.best_fit(size, left[size])
    return out.plan, out.count


def pack(pieces: DataFrame, capacity: int = 1024, groups: int = 64) -> DataFrame:
    """``pieces`` (see token_pieces) with sequence_id and offset. They are staged, as they are read several times."""
    spark, columns = pieces.sparkSession, pieces.columns
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt in turn, so that equal rows are spread too; staged, so that each stays where it was dealt.
    dealt = staged(pieces.withColumn("__b", F.pmod(F.monotonically_increasing_id(), F.lit(buckets))), "pieces")
    counts = dealt.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("length").alias("__length"), F.col("__b").alias("__bucket"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    histogram = {r[0]: r[1] for r in dealt.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan, _ = packing_plan(histogram, capacity, groups)
    places = spark.createDataFrame(plan, PLAN).withColumnRenamed("length", "__l")
    within = F.row_number().over(Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("__r", within).join(counts, (F.col("length") == F.col("__length")) & (F.col("__b") == F.col("__bucket"))).withColumn("__rank", F.col("__r") + F.col("__before"))
    at = (F.col("length") == F.col("__l")) & (F.col("__rank") >= F.col("first_rank")) & (F.col("__rank") < F.col("first_rank") + F.col("n"))
    placed = ranked.join(F.broadcast(places), at)
    return placed.select(*columns, (F.col("sequence_id") + F.col("__rank") - F.col("first_rank")).alias("sequence_id"), "offset")
