"""Token-id files coded by a static range asymmetric numeral system.

One table of frequencies, counted over all ids, is shared by all blocks. A block holds whole documents (about BLOCK_IDS
ids, or one longer document); its ids are dealt in turn to LANES coders whose words are interleaved in one stream. Every EVERY steps the coders'
states and the stream's position are kept as a checkpoint, so a block can be decoded from several points at once, and each
block ends with checksums of its bytes and of its ids. Blocks need nothing from each other.

A file set is a folder with ``frequencies`` (id, frequency; they sum up to 2 ** SCALE) and ``blocks`` (part, block,
first_token in the part, n_tokens, doc_ids, sizes, payload), both Parquet; parts and blocks are in ascending order of
doc_id (null first; equal ids by the checksum of their ids).

Payload, little-endian: ``RANS``, version and LANES (16 bits each), number of ids (64), EVERY (32), number of words (64),
checkpoints (each the stream's position and LANES states, 64 bits each), words (32), checksum of the ids (32), checksum of
all bytes before (32).

Defined cases: a null text is an empty one and gives the end id alone; null and repeated doc_ids are kept, each row for
itself; an empty table gives an empty file set and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_folder, small_batches, staged
from .tokens import crc_of_ids, encoder, with_end

LANES, EVERY, SCALE = 32, 512, 20
BLOCK_IDS, BLOCKS_AT_ONCE = 1 << 16, 16
#: Ids of a part at most, about: more parts are made than the session has shuffle partitions, where these would hold more.
PART_IDS = 1 << 26
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sHHQIQ")


class Damaged(ValueError):
    """A block whose bytes or ids don't match their checksum."""


class Table:
    """Frequencies of ids, scaled to a sum of 2 ** SCALE; each id that occurs has at least 1."""

    def __init__(self, frequency: np.ndarray):
        self.frequency = frequency.astype(np.uint64)
        self.start = np.cumsum(self.frequency) - self.frequency

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        there = counts > 0
        if there.sum() > 1 << (SCALE - 1):
            raise ValueError("too many distinct ids for the scale")
        room = (1 << SCALE) - int(there.sum())
        share = np.floor(counts * (room / max(1, counts.sum()))).astype(np.int64)
        frequency = np.where(there, share + 1, 0)
        if len(frequency):
            frequency[int(counts.argmax())] += (1 << SCALE) - int(frequency.sum())
        return cls(frequency)

    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))


def encode_blocks(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """The payloads of blocks of ids; all blocks are coded side by side."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    steps = [-(-len(blocks[k]) // LANES) for k in order]
    most = steps[0] if steps else 0
    filler = int(table.frequency.argmax()) if len(table.frequency) else 0
    ids = np.full((most, len(blocks), LANES), filler, dtype=np.uint32)
    for at, k in enumerate(order):
        flat = np.full(steps[at] * LANES, filler, dtype=np.uint32)
        flat[: len(blocks[k])] = blocks[k]
        ids[: steps[at], at] = flat.reshape(-1, LANES)
    state = np.full((len(blocks), LANES), LOW, dtype=np.uint64)
    words = np.empty((most, len(blocks), LANES), dtype=np.uint32)
    emitted = np.zeros((most, len(blocks), LANES), dtype=bool)
    kept: dict[int, np.ndarray] = {}
    shift, scale, half = np.uint64(63 - SCALE), np.uint64(SCALE), np.uint64(32)
    active = 0
    for step in range(most - 1, -1, -1):
        while active < len(steps) and steps[active] > step:
            active += 1
        f, c, x = table.frequency[ids[step, :active]], table.start[ids[step, :active]], state[:active]
        over = x >= f << shift
        words[step, :active] = x.astype(np.uint32)
        emitted[step, :active] = over
        x = np.where(over, x >> half, x)
        q = x // f
        state[:active] = (q << scale) + (x - q * f) + c
        if step % EVERY == 0:
            kept[step] = state.copy()
    out: list[bytes] = [b""] * len(blocks)
    for at, k in enumerate(order):
        flags = emitted[: steps[at], at]
        stream = words[: steps[at], at][flags]
        before = np.concatenate([[0], np.cumsum(flags.sum(axis=1))])
        body = HEAD.pack(b"RANS", 1, LANES, len(blocks[k]), EVERY, len(stream))
        body += b"".join(struct.pack("<Q", int(before[s])) + kept[s][at].astype("<u8").tobytes() for s in range(0, steps[at], EVERY))
        body += stream.astype("<u4").tobytes() + struct.pack("<I", crc_of_ids(blocks[k]))
        out[k] = body + struct.pack("<I", zlib.crc32(body))
    return out


def decode_blocks(payloads: list[bytes], table: Table, symbols: np.ndarray) -> list[np.ndarray]:
    """The ids of blocks; all stretches between checkpoints are decoded side by side."""
    spans: list[tuple[int, int, int]] = []  # block, first step, number of steps
    states, places, streams, sizes, checks = [], [], [], [], []
    base = 0
    for k, payload in enumerate(payloads):
        if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise Damaged("the block's bytes don't match their checksum")
        magic, version, lanes, n, every, n_words = HEAD.unpack_from(payload)
        if (magic, version, lanes) != (b"RANS", 1, LANES):
            raise Damaged("not a block of this format")
        steps, at = -(-n // LANES), HEAD.size
        for first in range(0, steps, every):
            places.append(base + struct.unpack_from("<Q", payload, at)[0])
            states.append(np.frombuffer(payload, "<u8", LANES, at + 8))
            spans.append((k, first, min(every, steps - first)))
            at += 8 + 8 * LANES
        streams.append(np.frombuffer(payload, "<u4", n_words, at))
        checks.append(struct.unpack_from("<I", payload, at + 4 * n_words)[0])
        sizes.append(n)
        base += n_words
    out = [np.empty(-(-n // LANES) * LANES, dtype=np.uint32) for n in sizes]
    if spans:
        order = np.argsort([-s[2] for s in spans], kind="stable")
        spans = [spans[i] for i in order]
        x = np.array(states, dtype=np.uint64)[order]
        place = np.array(places, dtype=np.int64)[order]
        stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
        got = np.empty((spans[0][2], len(spans), LANES), dtype=np.uint32)
        mask, scale, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        active = len(spans)
        for step in range(spans[0][2]):
            while spans[active - 1][2] <= step:
                active -= 1
            now = x[:active]
            slot = now & mask
            symbol = symbols[slot]
            got[step, :active] = symbol
            now = table.frequency[symbol] * (now >> scale) + slot - table.start[symbol]
            need = now < LOW
            count = np.cumsum(need, axis=1)
            word = stream[np.where(need, place[:active, None] + count - 1, 0)]
            x[:active] = np.where(need, (now << half) | word, now)
            place[:active] += count[:, -1]
        for i, (k, first, n) in enumerate(spans):
            out[k][first * LANES : (first + n) * LANES] = got[:n, i].reshape(-1)
    out = [ids[:n] for ids, n in zip(out, sizes, strict=True)]
    for ids, check in zip(out, checks, strict=True):
        if crc_of_ids(ids) != check:
            raise Damaged("the block's ids don't match their checksum")
    return out


def squeezed(ids: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Ids for the way between stages: two bytes each where they fit, else four, compressed."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + press.compress(ids.astype(f"<u{width}").tobytes())


def unsqueezed(data: bytes, open_: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(open_.decompress(data[1:]), f"<u{data[0]}").astype("<u4")


def token_ids(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """doc_id, ids (see squeezed) and their checksum for each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press = encoder(vocabulary), zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids, sizes = with_end(*enc.encode(batch.column("text")), end_id)
                each = np.split(ids, np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([squeezed(x, press) for x in each], pa.binary()), pa.array([crc_of_ids(x) for x in each], pa.int64())],
                    ["doc_id", "ids", "crc"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids binary, crc long")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs. A task gives a row for each id it saw; the sums, a row for each id of the vocabulary at
    most, go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, total = zstandard.ZstdDecompressor(), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                n = np.bincount(np.concatenate([unsqueezed(data.as_py(), open_) for data in batch.column("ids").slice(at, 200)]))
                if len(n) > len(total):
                    total, n = n, total
                total[: len(n)] += n
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 + max((r[0] for r in rows), default=-1), np.int64)
    for r in rows:
        out[r[0]] = r[1]
    return out


def write_tokens(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 2) -> str:
    """Writes a file set and returns its folder."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or own_folder(spark, "token-files")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    tokens = staged(token_ids(docs, vocabulary, end_id), "token-ids")
    counts = id_counts(tokens)
    table = Table.of_counts(counts)
    spark.createDataFrame([(k, int(f)) for k, f in enumerate(table.frequency) if f], "id long, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, part = zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        state = {"block": 0, "first": 0}
        filled: list[tuple[list, list[np.ndarray]]] = []
        ids: list = []
        parts: list[np.ndarray] = []

        def written() -> pa.RecordBatch:
            blocks = [np.concatenate(p) for _, p in filled]
            sizes = [len(b) for b in blocks]
            first = state["first"] + np.cumsum([0, *sizes[:-1]])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(blocks), pa.int32()),
                    pa.array(range(state["block"], state["block"] + len(blocks)), pa.int32()),
                    pa.array(first, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([i for i, _ in filled], pa.list_(of_ids)),
                    pa.array([[len(x) for x in p] for _, p in filled], pa.list_(pa.int64())),
                    pa.array(encode_blocks(blocks, table), pa.binary()),
                ],
                ["part", "block", "first_token", "n_tokens", "doc_ids", "sizes", "payload"],
            )
            state["block"] += len(blocks)
            state["first"] += sum(sizes)
            filled.clear()
            return out

        have, of_ids = 0, pa.null()
        for batch in batches:
            of_ids = batch.schema.field("doc_id").type
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                tokens = unsqueezed(data.as_py(), open_)
                # Blocks that are coded together are filled up to the longest; one that holds a long document is coded alone.
                if len(tokens) > BLOCK_IDS:
                    if ids:
                        filled.append((ids, parts))
                    if filled:
                        yield written()
                    filled.append(([doc_id], [tokens]))
                    yield written()
                    ids, parts, have = [], [], 0
                    continue
                ids.append(doc_id)
                parts.append(tokens)
                have += len(tokens)
                if have >= BLOCK_IDS:
                    filled.append((ids, parts))
                    ids, parts, have = [], [], 0
                    if len(filled) == BLOCKS_AT_ONCE:
                        yield written()
        if ids:
            filled.append((ids, parts))
        if filled:
            yield written()

    tokens = tokens.withColumn("__tie", F.monotonically_increasing_id())  # so that equal rows need not share a part
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // PART_IDS))
    ordered = tokens.repartitionByRange(partitions, "doc_id", "crc", "__tie").sortWithinPartitions("doc_id", "crc")
    schema = f"part int, block int, first_token long, n_tokens long, doc_ids array<{id_type}>, sizes array<long>, payload binary"
    ordered.select("doc_id", "ids").mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of each document."""
    blocks = spark.read.parquet(f"{path}/blocks")
    rows = spark.read.parquet(f"{path}/frequencies").collect()  # a row for each id of the vocabulary at most
    frequency = np.zeros(1 + max((r["id"] for r in rows), default=-1), np.uint64)
    for r in rows:
        frequency[r["id"]] = r["frequency"]
    sums = blocks.groupBy("part").agg(F.sum("n_tokens")).collect()  # a row for each part
    offsets, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in sums):
        offsets.append((part, total))
        total += n
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(frequency)
        symbols = table.symbols()
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCKS_AT_ONCE):
                batch = whole.slice(at, BLOCKS_AT_ONCE)
                blocks = decode_blocks(batch.column("payload").to_pylist(), table, symbols)
                part, first, n, crc, ids = [], [], [], [], []
                for k, block in enumerate(blocks):
                    start = batch.column("first_token")[k].as_py()
                    size = np.array(batch.column("sizes")[k].as_py(), np.int64)
                    begin = np.cumsum(size) - size
                    each = [block[b : b + m] for b, m in zip(begin, size, strict=True)]
                    part += [batch.column("part")[k].as_py()] * len(size)
                    first += (start + begin).tolist()
                    n += size.tolist()
                    crc += [crc_of_ids(x) for x in each]
                    ids += each if with_ids else []
                columns = [batch.column("doc_ids").flatten(), pa.array(part, pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "first", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, part int, first long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    decoded = blocks.select("part", "first_token", "doc_ids", "sizes", "payload").mapInArrow(run, schema)
    places = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    out = decoded.join(places, "part").withColumn("start", F.col("first") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
