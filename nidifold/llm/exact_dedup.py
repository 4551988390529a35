"""Exact duplicates by deterministic block naming.

A text without its white space is cut into blocks of a fixed number of bytes. Distinct blocks are sorted, by hash and then by
content, and named with integers in that order; then adjacent pairs of names are sorted and named in the same way, again and
again, until one name is left of each document. Names depend on the set of contents alone, not on how rows are partitioned.
Two documents are equal exactly if they end at the same level with the same name: names are given to distinct contents, so
there are no collisions. (Rows find their block's name by the block's 64-bit hash; where two distinct blocks of the corpus
share a hash, those rows compare the blocks themselves.) Rows are told apart by numbers of their own, not by id or text.

A document that holds a block, or pair, that occurs once in the corpus is equal to no other, so it needs no more names.

Texts are read once; what is needed of them is staged. Blocks and pairs that many copies share are counted where they lie
before names are given, and joined by a broadcast of the few hot ones (see join_counted), so no task gets all copies of one.

Defined cases: a null text is an empty one, and all texts without other characters than white space are equal. Of equal
texts the row with the most code points stays, then the smallest doc_id (null comes last), then any one. A row that is
repeated counts each time, and stays once. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_SPACE, join_counted, last_kept, same, staged, without

BLOCK = 1024
#: Names are given within this many ranges of hashes (a power of two), each of which has names of its own.
RANGES, NAMES = 4096, 1 << 48
#: Marks names of blocks that share their hash with others.
SHARED = 1 << 61


def normalised(text: Column) -> Column:
    return reduce(lambda c, space: F.replace(c, F.lit(space), F.lit("")), ASCII_SPACE, F.coalesce(text, F.lit("")))


def blocked(docs: DataFrame, row: str | None, block: int, block_hash, *own: str) -> DataFrame:
    """__row, doc_id, the columns ``own``, __points, text_sha256, __blocks and their __hashes of each row; the one pass over the
    texts. __row is the column ``row``, or a number."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    base = docs.select(number.alias("__row"), "doc_id", *own, F.length(F.coalesce("text", F.lit(""))).alias("__points"), normalised(F.col("text")).cast("binary").alias("__norm"))
    last = F.greatest(F.lit(1), F.ceil(F.octet_length("__norm") / F.lit(block))).cast("int") - 1
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("__norm"), i * F.lit(block) + 1, F.lit(block)))
    out = base.select("__row", "doc_id", *own, "__points", F.sha2("__norm", 256).alias("text_sha256"), cut.alias("__blocks"))
    return staged(out.withColumn("__hashes", F.transform("__blocks", lambda b: block_hash(b))), "blocks")


def named(distinct: DataFrame, content: list[str], label: str) -> DataFrame:
    """``distinct`` contents with their hash ``__h``, and an integer ``__name`` for each, in the order of (hash, content)."""
    bits = RANGES.bit_length() - 1
    told = distinct.withColumn("__r", F.shiftrightunsigned("__h", 64 - bits))
    place = F.row_number().over(Window.partitionBy("__r").orderBy("__h", *content)) - 1
    return staged(told.withColumn("__name", F.col("__r") * F.lit(NAMES) + place).drop("__r"), label)


def gathered(parts: DataFrame, label: str) -> DataFrame:
    """__row, its __names in order, and how often the rarest of them occurs (__least)."""
    pairs = F.sort_array(F.collect_list(F.struct("__pos", "__name")))
    return staged(parts.groupBy("__row").agg(F.transform(pairs, lambda p: p["__name"]).alias("__names"), F.min("__n").alias("__least")), label)


def block_names(rows: DataFrame) -> DataFrame:
    """__row, __pos, __name and __n (how often the block occurs) of each block of each document."""
    contents = rows.select(F.inline(F.arrays_zip(F.col("__hashes").alias("__h"), F.col("__blocks").alias("__block"))))
    distinct = contents.groupBy("__h", "__block").agg(F.count(F.lit(1)).alias("__n"))
    names = named(distinct.groupBy("__h").agg(F.count(F.lit(1)).alias("__same"), F.sum("__n").alias("__n")), [], "block-names")
    names = names.withColumn("__count", F.col("__n"))  # join_counted takes one of the two
    places = rows.select("__row", F.posexplode("__hashes").alias("__pos", "__h"))
    total = rows.agg(F.sum(F.size("__hashes"))).collect()[0][0] or 0
    out = ["__row", "__pos", "__name", F.col("__count").alias("__n")]
    shared = names.filter("__same > 1").select("__h")
    if not shared.limit(1).count():
        return join_counted(places, names.drop("__same"), ["__h"], "__n", total).select(*out)
    # Distinct blocks with one hash: their rows are joined on the contents.
    there = rows.select("__row", F.posexplode(F.arrays_zip(F.col("__hashes").alias("h"), F.col("__blocks").alias("b"))).alias("__pos", "p")).select("__row", "__pos", F.col("p.h").alias("__h"), F.col("p.b").alias("__block"))
    there = staged(there.join(shared, "__h", "left_semi"), "blocks-text")
    exact = named(there.groupBy("__h", "__block").agg(F.count(F.lit(1)).alias("__n")), ["__block"], "names-text").drop("__h")
    exact = exact.withColumn("__name", F.col("__name") + F.lit(SHARED)).withColumn("__count", F.col("__n"))
    exact = join_counted(there, exact, ["__block"], "__n", total)
    rest = join_counted(places, names.filter("__same = 1").drop("__same"), ["__h"], "__n", total)
    return rest.select(*out).unionByName(exact.select(*out))


def identities(rows: DataFrame) -> DataFrame:
    """__row with its collision-free identity (__level, __name); level -1 is for rows that are equal to no other."""
    docs, level, done = gathered(block_names(rows), "names-0"), 0, []
    while True:
        done.append(docs.filter("__least = 1").select("__row", F.lit(-1).alias("__level"), F.col("__row").alias("__name")))
        done.append(docs.filter("__least > 1 AND size(__names) = 1").select("__row", F.lit(level).alias("__level"), F.col("__names")[0].alias("__name")))
        open_ = docs.filter("__least > 1 AND size(__names) > 1")
        total = open_.agg(F.sum(F.ceil(F.size("__names") / 2))).collect()[0][0]
        if not total:
            break
        halves = F.sequence(F.lit(0), F.floor((F.size("__names") - 1) / 2).cast("int"))
        pairs = F.transform(halves, lambda i: F.struct(F.get("__names", i * 2).alias("a"), F.coalesce(F.get("__names", i * 2 + 1), F.lit(-1)).alias("b")))
        places = open_.select("__row", F.posexplode(pairs).alias("__pos", "p")).select("__row", "__pos", F.col("p.a").alias("__a"), F.col("p.b").alias("__b"))
        distinct = places.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", F.xxhash64("__a", "__b"))
        level += 1
        names = named(distinct, ["__a", "__b"], f"pair-names-{level}").drop("__h").withColumn("__count", F.col("__n"))
        parts = join_counted(places, names, ["__a", "__b"], "__n", total)
        docs = gathered(parts.select("__row", "__pos", "__name", F.col("__count").alias("__n")), f"names-{level}")
    return reduce(DataFrame.unionByName, done)


def exact_duplicates(docs: DataFrame, block: int = BLOCK, block_hash=F.xxhash64, number: str | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, __row (a number) and the column ``number``,
    if given."""
    own = [] if number is None else [number]
    rows = blocked(docs, None, block, block_hash, *own)
    attributes = rows.select("__row", "doc_id", *own, "__points", "text_sha256")
    each = staged(attributes.join(identities(rows), "__row"), "identities")
    single = each.filter("__level < 0").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "__row", *own)
    several = each.filter("__level >= 0")
    # Of equal texts: most code points, then the smallest doc_id; null last.
    order = F.min(F.struct((-F.col("__points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("__row").alias("r")))
    groups = staged(several.groupBy("__level", "__name").agg(order.alias("__best"), F.count(F.lit(1)).alias("group_size"), F.count(F.lit(1)).alias("__n")), "groups")
    out = join_counted(several, groups, ["__level", "__name"], "__n", several.count())
    out = out.select("doc_id", F.col("__best.i").alias("keep_id"), "group_size", (F.col("__row") == F.col("__best.r")).alias("kept"), "text_sha256", "__row", *own)
    return single.unionByName(out)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows are told apart by their doc_id; only those without one, or
    with one that comes again, are staged with numbers."""
    with last_kept(docs.sparkSession):
        ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__again"))
        ids = staged(ids, "repeated-ids")
        again = docs.join(ids, same(F.col("doc_id"), F.col("__again")), "left_semi")
        again = staged(again.withColumn("__number", F.monotonically_increasing_id()), "numbered")
    any_again = again.limit(1).count()
    own = without(docs, [F.col("doc_id")], again.select("doc_id").distinct()) if any_again else docs
    rows = own.select("doc_id", "text", F.lit(None).cast("long").alias("__number"))
    rows = rows.unionByName(again.select("doc_id", "text", "__number")) if any_again else rows
    with last_kept(docs.sparkSession):
        kept = staged(exact_duplicates(rows, number="__number").filter("group_size > 1").select("doc_id", "__number", "kept"), "kept-rows")
    lost = kept.filter("NOT kept")
    out = without(own, [F.col("doc_id")], lost.filter("__number IS NULL").select("doc_id"))
    if not any_again:
        return out
    return out.unionByName(without(again, [F.col("__number")], lost.filter("__number IS NOT NULL").select("__number")).select(*docs.columns))
