"""Near-duplicates by b-bit MinHash.

A document's set holds its distinct shingles of ``words`` words (hashed to 64 bits); its signature keeps the low ``BITS``
bits of PERMUTATIONS minima, packed; the full minima serve only to make band keys. Documents that share a band are candidates;
a pair's similarity is first estimated from the signatures' equal bit groups, corrected for chance collisions, and pairs
far below the threshold are left; all others are confirmed on the documents' full sets.

Groups of copies never become all their pairs. Equal sets are one class from the start. In each band bucket the members
are compared with one of them (a star); confirmed links give components; then only members of different components of one
bucket are compared, each member outside a bucket's largest component with the others, less those members whose own shingles
alone rule out every link in the bucket. Pairs left out lie in one component already, or are no links, so the components are
those of all linked candidates.

With 25 bands of 5 minima a pair at similarity 0.8 is missed by all bands with probability 0.00005, one at 0.85 with
0.0000009; the estimate's margin is over five standard deviations.

Defined cases: a null or empty text has an empty set and is linked with nothing; with fewer words than a shingle has, the
whole sequence is the one shingle; rows repeated with their doc_id are one document to links, and each is returned; rows with
one doc_id and different texts take part with each text; a null doc_id is linked with nothing and is a component of its own
(null). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, join_counted, last_kept, small_batches, staged, text_hash
from .components import components
from .tokens import forget

BANDS, PER_BAND, BITS = 25, 5, 2
PERMUTATIONS = BANDS * PER_BAND
#: By how much the estimate may lie below the threshold.
MARGIN = 0.25
#: Members of buckets with several components get a longer signature of the same kind, and so a smaller margin.
LONG, LONG_MARGIN = 1024, 0.065
#: Pairs of one document, and members of one bucket, that a task takes at once, about.
PAIRS_AT_ONCE, MEMBERS_AT_ONCE = 10_000, 2_000
_seeds = np.random.default_rng(20_240_601)
FACTORS = _seeds.integers(1, 1 << 32, PERMUTATIONS + LONG, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
OFFSETS = _seeds.integers(0, 1 << 32, PERMUTATIONS + LONG, dtype=np.uint64).astype(np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiplications and shifts)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts in a row, sorted within each text, and their number for each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lower = pc.ascii_lower(texts.take(pa.array(np.arange(len(texts)))))  # a copy: ascii_lower misreads what a slice was cast to
    for space in ASCII_SPACE[1:]:
        lower = pc.replace_substring(lower, space, " ")
    lists = pc.split_pattern(lower, " ")
    flat = lists.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    by_word = pd.util.hash_array(names, categorize=False).astype(np.uint64) if len(names) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[filled]
    h = by_word[coded.indices.to_numpy(zero_copy_only=False)][filled] if len(names) else np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=len(texts))
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        value = np.zeros(len(h), np.uint64)
        for k in range(words):
            at = np.arange(len(h)) + k
            inside = at < (first + count)[row]  # shorter sequences end early, as one shingle
            value = np.where(inside, mixed(value * MIX + h[np.minimum(at, max(0, len(h) - 1))]), value)
    place = np.arange(len(h)) - first[row]
    use = place < np.maximum(1, count - words + 1)[row]
    row, value = row[use], value[use]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(row[new], minlength=len(texts))


def minima(values: np.ndarray, sizes: np.ndarray, first: int = 0, n: int = PERMUTATIONS) -> np.ndarray:
    """``n`` minima, from the ``first`` permutation on, of each non-empty set, as rows."""
    there = sizes > 0
    begin = (np.cumsum(sizes) - sizes)[there]
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n, len(begin)), np.uint32)
    if len(begin):
        for k in range(n):
            out[k] = np.minimum.reduceat(x * FACTORS[first + k] + OFFSETS[first + k], begin)
    return out.T


def packed_bits(low: np.ndarray) -> np.ndarray:
    """The low bits of minima, mixed, in words of 64 bits."""
    words = -(-low.shape[1] * BITS // 64)
    groups = np.zeros((len(low), words * 64 // BITS), np.uint64)
    groups[:, : low.shape[1]] = mixed(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    return (groups.reshape(len(low), words, -1) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set (a 128-bit digest of the sorted set; null if it is empty), packed (the b-bit signature) and
    bands of each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                values, sizes = shingle_sets(batch.column("text"), words)
                low = minima(values, sizes)
                there = np.flatnonzero(sizes > 0)
                ends = np.cumsum(sizes)
                digest: list[bytes | None] = [None] * batch.num_rows
                for i in there:
                    digest[i] = blake2b(values[ends[i] - sizes[i] : ends[i]].tobytes(), digest_size=16).digest()
                packed = packed_bits(low)
                keys = np.zeros((len(there), BANDS), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(PER_BAND):
                        keys = mixed(keys * MIX + low[:, k::PER_BAND].astype(np.uint64))
                lists = lambda x: pa.array([None if r is None else x[r] for r in spread], pa.list_(pa.int64()))
                spread: list[int | None] = [None] * batch.num_rows
                for r, i in enumerate(there):
                    spread[i] = r
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), lists(packed), lists(keys.view(np.int64))],
                    ["doc_id", "n_shingles", "set", "packed", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_shingles long, set binary, packed array<long>, bands array<long>")


def estimate(a: str, b: str, permutations: int = PERMUTATIONS):
    """The similarity that two packed signatures show: the share of equal bit groups, less what chance makes equal."""
    low = F.lit(0x5555555555555555).cast("long")
    unlike = lambda x: x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(low)
    differ = sum((F.bit_count(unlike(F.col(a)[k].bitwiseXOR(F.col(b)[k]))) for k in range(-(-permutations * BITS // 64))), F.lit(0))
    chance = 1 / (1 << BITS)
    return (1 - differ / F.lit(permutations) - chance) / (1 - chance)


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (staged) with the texts ta and tb of their documents. The pairs of a document in very many of them are dealt
    into parts of about PAIRS_AT_ONCE, each of which meets a copy of the text, so no task has to take them all."""
    out, total, copies = pairs.select("a", "b"), pairs.count(), {}
    for side, other in (("a", "b"), ("b", "a")):
        counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("__n")).withColumn(f"__parts{side}", F.ceil(F.col("__n") / PAIRS_AT_ONCE).cast("int"))
        counts = staged(counts, f"pairs-of-{side}")
        out = join_counted(out, counts, [side], "__n", total).withColumn(f"__part{side}", F.pmod(F.xxhash64(other), F.col(f"__parts{side}")).cast("int")).drop(f"__parts{side}")
        own = texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}")).join(counts, side)
        copies[side] = own.select(side, f"t{side}", F.explode(F.sequence(F.lit(0), F.col(f"__parts{side}") - 1)).alias(f"__part{side}"))
    out = staged(out, "dealt-pairs")
    for side in ("a", "b"):
        out = out.join(copies[side], [side, f"__part{side}"])
    return out.select("a", "b", "ta", "tb")


def measured(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) with the sizes of their full sets and of what these have in common: na, nb, common."""
    both = with_texts(pairs, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = pa.chunked_array([batch.column("ta"), batch.column("tb")])
                coded = texts.combine_chunks().dictionary_encode()  # a text in many pairs is cut once
                values, sizes = shingle_sets(coded.dictionary, words)
                ends = np.cumsum(sizes)
                sets = [values[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                at_ = coded.indices.to_numpy(zero_copy_only=False)
                i, j = at_[: batch.num_rows], at_[batch.num_rows :]
                common = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sizes[i], pa.int64()), pa.array(sizes[j], pa.int64()), pa.array(common, pa.int64())], ["a", "b", "na", "nb", "common"])

    id_type = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {id_type}, b {id_type}, na long, nb long, common long")


def is_link(percent: int):
    return 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))


def own_shingles(texts: DataFrame, words: int) -> DataFrame:
    """lead and own: how many shingles of a document are in no other document of ``texts`` (lead, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                values, sizes = shingle_sets(batch.column("text"), words)
                yield pa.RecordBatch.from_arrays([batch.column("lead").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(values.view(np.int64))], ["lead", "h"])

    rows = texts.select("lead", "text").mapInArrow(run, f"lead {texts.schema['lead'].dataType.simpleString()}, h long")
    single = rows.groupBy("h").agg(F.min("lead").alias("lead"), F.max("lead").alias("last")).filter("lead = last")
    return single.groupBy("lead").agg(F.count(F.lit(1)).alias("own"))


def long_signatures(texts: DataFrame, words: int) -> DataFrame:
    """lead and long, a packed signature of LONG minima; null for an id with several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                values, sizes = shingle_sets(batch.column("text"), words)
                packed = packed_bits(minima(values, sizes, PERMUTATIONS, LONG))
                leads = batch.column("lead").filter(pa.array(sizes > 0))
                yield pa.RecordBatch.from_arrays([leads, pa.array(list(packed), pa.list_(pa.int64()))], ["lead", "long"])

    rows = texts.select("lead", "text").mapInArrow(run, f"lead {texts.schema['lead'].dataType.simpleString()}, long array<long>")
    return rows.groupBy("lead").agg(F.when(F.count(F.lit(1)) == 1, F.first("long")).alias("long"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    rows = staged(signatures(docs, words), "signatures")
    # Equal sets are one class, led by its least doc_id.
    leaders = rows.filter("set IS NOT NULL AND doc_id IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("packed").alias("packed"), F.first("bands").alias("bands"))
    leaders = staged(leaders, "leaders")
    # A doc_id with several texts leads several classes; those are linked through it.
    marks = leaders.select("lead", "n", "packed")
    bands = staged(leaders.select("lead", F.posexplode("bands").alias("band", "key")), "bands")
    buckets = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.min("lead").alias("hub")).filter("members > 1")
    # The hub's signature comes with its bucket, so that no join has to bring all of a hub's members together. It is left
    # out for an id with several texts.
    hubs = marks.groupBy(F.col("lead").alias("hub")).agg(*[F.when(F.count(F.lit(1)) == 1, F.first(c)).alias(x) for c, x in (("n", "nb"), ("packed", "pb"))])
    buckets = staged(buckets.join(hubs, "hub"), "buckets")
    members = staged(join_counted(bands, buckets, ["band", "key"], "members", bands.count()), "members")

    # The texts of documents that are in a bucket with others: all that is ever compared.
    texts = docs.join(members.select(F.col("lead").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = staged(texts.select("doc_id", "text"), "texts")

    # Stars: each member with its bucket's hub.
    a = marks.select(F.col("lead").alias("a"), F.col("n").alias("na"), F.col("packed").alias("pa"))
    pairs = members.select(F.col("lead").alias("a"), F.col("hub").alias("b"), "nb", "pb").filter("a <> b").dropDuplicates(["a", "b"]).join(a, "a")
    likely = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate("pa", "pb") >= percent / 100 - MARGIN)
    likely = F.coalesce(likely, F.lit(True))
    stars = staged(measured(staged(pairs.filter(likely).select("a", "b").distinct(), "star-pairs"), texts, words), "stars")
    links = stars.filter(is_link(percent)).select("a", "b").distinct()
    own = components(links)
    of = own.select(F.col("node").alias("lead"), F.col("component").alias("c"))
    told = staged(members.drop("nb", "pb").join(of, "lead", "left").withColumn("c", F.coalesce("c", "lead")), "told")
    parts = told.groupBy("band", "key", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed_buckets = parts.groupBy("band", "key").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "c"))["c"].alias("main"))
    mixed_buckets = staged(mixed_buckets.filter("parts > 1 AND members > 2").drop("parts"), "mixed-buckets")
    open_ = staged(join_counted(told, mixed_buckets, ["band", "key"], "members", told.count()), "open")
    # What a member's set and the hub's do not share (d), less the shingles that no other open document has (e): two members
    # of one hub differ in at least d + d' - 2 min(e, e') shingles, which rules most pairs out without a look at them.
    if open_.limit(1).count():
        d = stars.select(F.col("a").alias("lead"), F.col("b").alias("hub"), (F.col("na") + F.col("nb") - 2 * F.col("common")).alias("d"))
        d = d.groupBy("lead", "hub").agg(F.when(F.count(F.lit(1)) == 1, F.max("d")).alias("d"))  # none for ids with several texts
        open_texts = staged(texts.withColumnRenamed("doc_id", "lead").join(open_.select("lead").distinct(), "lead", "left_semi"), "open-texts")
        open_ = open_.join(d, ["lead", "hub"], "left").join(own_shingles(open_texts, words).join(long_signatures(open_texts, words), "lead", "full"), "lead", "left")
        open_ = open_.withColumn("d", F.when(F.col("lead") == F.col("hub"), 0).otherwise(F.col("d"))).withColumn("e", F.col("d") - F.when(F.col("lead") == F.col("hub"), 0).otherwise(F.coalesce("own", F.lit(0))))
        # Two documents differ in all that is their own, which a link allows up to a share of their sizes. A member that even
        # the one with most room in its bucket can't make up for is in no link there.
        room = F.when(F.col("long").isNotNull(), (100 - percent) * F.col("n") - (100 + percent) * F.coalesce("own", F.lit(0)))
        open_ = open_.join(marks, "lead").withColumn("room", F.coalesce(room, F.lit(1 << 50)))
        open_ = staged(open_.select("band", "key", "lead", "hub", "c", "main", "n", "long", "d", "e", "room"), "open-measured")
        most = staged(open_.groupBy("band", "key").agg(F.max("room").alias("most"), F.count(F.lit(1)).alias("of")), "open-rooms")
        left = staged(join_counted(open_, most, ["band", "key"], "of", open_.count()).filter("room + most >= 0").drop("room", "most"), "open-left")
        counts = left.groupBy("band", "key").agg(F.count(F.lit(1)).alias("of")).withColumn("parts", F.ceil(F.col("of") / MEMBERS_AT_ONCE).cast("int"))
        open_ = join_counted(left, staged(counts, "open-counts"), ["band", "key"], "of", left.count())
    else:
        open_ = open_.join(marks, "lead").select("*", F.lit(None).cast("array<long>").alias("long"), F.lit(None).cast("long").alias("d"), F.lit(None).cast("long").alias("e"), F.lit(1).alias("parts"))
    # Members outside the largest component are dealt into parts, each of which meets all members.
    side = lambda x: open_.select("band", "key", "parts", F.col("hub").alias(f"hub{x}"), F.col("lead").alias(x), *[F.col(k).alias(k + x) for k in ("c", "n", "d", "e", "main")], F.col("long").alias(f"long{x}"))
    odd = side("a").filter("ca <> maina").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).alias("o")
    rest = side("b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("r")
    differ = F.col("da") + F.col("db") - 2 * F.least("ea", "eb")
    possible = F.coalesce(differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent), F.lit(True))
    likely = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & F.coalesce(estimate("longa", "longb", LONG) >= percent / 100 - LONG_MARGIN, F.lit(True))
    near = (F.col("ca") != F.col("cb")) & possible & likely & (F.col("a") != F.col("huba")) & (F.col("b") != F.col("huba"))
    more = odd.join(rest, (F.col("o.band") == F.col("r.band")) & (F.col("o.key") == F.col("r.key")) & (F.col("o.part") == F.col("r.part")) & near).select("a", "b")
    pairs = staged(more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cross-pairs")
    every = own.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")
    if pairs.limit(1).count():
        every = every.unionByName(staged(measured(pairs, texts, words).filter(is_link(percent)).select("a", "b").distinct(), "cross-links"))
    # Members of a class are linked to its leader; a repeated doc_id with several texts joins its classes.
    several = rows.filter("set IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("set").alias("sets")).filter("sets > 1").select("doc_id")
    several = staged(several, "several")
    if several.limit(1).count():
        across = rows.join(several, "doc_id", "left_semi").select("doc_id", "set").distinct().join(leaders.select("set", "lead"), "set").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
        every = every.unionByName(across.filter("a <> b"))
    final = components(every).select(F.col("node").alias("lead"), F.col("component").alias("c"))
    classes = staged(leaders.join(final, "lead", "left").select("set", "copies", F.coalesce("c", "lead").alias("component_id")), "classes")
    whole = rows.select("doc_id", "n_shingles", "set")
    out = join_counted(whole.filter("set IS NOT NULL AND doc_id IS NOT NULL"), classes, ["set"], "copies", rows.count()).select("doc_id", "n_shingles", "component_id")
    alone = whole.filter("set IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one row of each component, with all their columns. Rows without a doc_id, or with one
    that comes again, are told apart by their texts; of their components those with an id of its own stay first."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1 OR doc_id IS NULL")
    ids = staged(ids.withColumn("__again", F.lit(True)), "repeated-ids")
    if not ids.limit(1).count():
        with last_kept(docs.sparkSession):
            lost = staged(near_duplicates(docs, words, percent).filter("NOT kept").select("doc_id").distinct(), "near-lost")
        return docs.join(lost, "doc_id", "left_anti")
    # Keys in the upper half of the positive numbers, made of id and text.
    own = F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), text_hash()).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = join_counted(docs, ids, ["doc_id"], "__n", docs.count(), "left")
    rows = staged(rows.withColumn("__key", F.when(F.col("__again"), own).otherwise(F.col("doc_id"))), "keyed")
    with last_kept(docs.sparkSession):
        found = staged(near_duplicates(rows.select(F.col("__key").alias("doc_id"), "text"), words, percent), "near-rows")
    out = rows.join(found.filter("NOT kept").select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti")
    # Rows that come again with their id and text: one of each; texts without shingles are like no other.
    copies = staged(found.filter("kept AND n_shingles > 0").groupBy(F.col("doc_id").alias("__key")).count().filter("count > 1").select("__key"), "copies")
    once = out.join(copies, "__key", "left_semi").dropDuplicates(["__key"])
    return out.join(copies, "__key", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
