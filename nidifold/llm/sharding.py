"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, whose number never changes; bytes and rows are summed by slot; a versioned map
says which slot is in which shard. Version 1 deals the slots in turn. Rebalancing edits the map: it moves single slots from
the fullest to the emptiest shard until no move evens them out further. Only the sums of the slots (a fixed number of rows)
reach the driver, and only the map is broadcast.

Defined cases: a null text has no bytes and the checksum of an empty one; null and repeated ids are hashed with their
text's checksum; equal rows share a slot and get different places; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import own_folder, staged

SLOTS = 16_384
ROW_BYTES = 16
PARTS = 64
MAP = T.StructType([T.StructField("version", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("vslot", "bytes", "rows")), T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())])


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return out.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)))


def rebalanced(owner: list[int], weight: list[int], shards: int) -> list[int]:
    """The map with slots moved, one at a time, from the fullest shard to the emptiest, each time the slot that evens the
    two best, until none brings them closer."""
    owner = list(owner)
    load = [0] * shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += weight[slot]
        if weight[slot]:
            own[shard].append((weight[slot], slot))
    while True:
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        move = min((x for x in own[full] if x[0] < gap), key=lambda x: abs(gap - 2 * x[0]), default=None)
        if move is None:
            return owner
        own[full].remove(move)
        own[empty].append(move)
        load[full] -= move[0]
        load[empty] += move[0]
        owner[move[1]] = empty


class SlotMap:
    """A versioned slot-to-shard map, kept as a table: one Parquet folder per version. A map made for a path goes on from the
    versions that are there."""

    def __init__(self, spark: SparkSession, path: str | None = None, slots: int = SLOTS):
        self.spark, self.slots = spark, slots
        self.path = path or own_folder(spark, "slot-map")
        self.version = max(self.versions(), default=0)

    def versions(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.removeprefix("version=").removesuffix(".parquet")) for n in names if n.startswith("version="))

    def store(self, owner: list[int], weight: list[int], rows: list[int]) -> DataFrame:
        """Writes the next version; ``base`` counts the rows of the shard's slots before this one."""
        seen: dict[int, int] = {}
        table = []
        for slot in range(self.slots):
            base = seen.get(owner[slot], 0)
            table.append((self.version + 1, slot, weight[slot], rows[slot], owner[slot], base))
            seen[owner[slot]] = base + rows[slot]
        self.spark.createDataFrame(table, MAP).coalesce(1).write.parquet(f"{self.path}/version={self.version + 1}.parquet")
        self.version += 1
        return self.load(self.version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP).parquet(f"{self.path}/version={version}.parquet")

    def owners(self, version: int) -> list[int]:
        """The shard of each slot."""
        owner = [0] * self.slots
        for r in self.load(version).select("vslot", "shard").collect():  # a row for each slot
            owner[r[0]] = r[1]
        return owner


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the row's place in its shard, from 0), grown_shard and vslot.

    ``path``: where the slot map is kept. If it has a version already, that is rebalanced for these rows; slots of shards
    that are no more are dealt anew. Rows are numbered within their slots in PARTS parts, each of which goes on where the one
    before ends, so a slot with very many rows (one id and text repeated, say) is no task of its own.
    """
    # Staged, so that a row's part stays what it is.
    rows = staged(records(docs, slots).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")), "records")
    parts = rows.groupBy("vslot", "__part").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    parts = staged(parts, "slot-parts")  # PARTS rows for each slot at most
    weight, count = [0] * slots, [0] * slots
    for r in parts.groupBy("vslot").agg(F.sum("__bytes"), F.sum("__rows")).collect():  # a row for each slot at most
        weight[r[0]], count[r[0]] = r[1], r[2]
    slot_map = SlotMap(docs.sparkSession, path, slots)
    if not slot_map.version:
        slot_map.store([s % shards for s in range(slots)], weight, count)
    first = [o if o < shards else s % shards for s, o in enumerate(slot_map.owners(slot_map.version))]
    current = slot_map.store(rebalanced(first, weight, shards), weight, count)
    before = Window.partitionBy("vslot").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("vslot", "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("vslot", "__part").orderBy("doc_id", "text_crc32")) - 1
    out = rows.withColumn("__place", place).join(parts, ["vslot", "__part"]).join(F.broadcast(current.select("vslot", "shard", "base")), "vslot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("__before") + F.col("__place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")
