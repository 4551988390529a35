"""Benchmark decontamination by latent semantic retrieval.

Texts become words (lower case; letters and digits), words become hashed numbers, and all documents are cut into passages of
PASSAGE words, half overlapping. Passages are TF-IDF vectors, with document frequencies counted over the passages of all
documents. A randomised singular value decomposition (single pass, Nystroem) of the passages of all documents and of the
benchmark gives a latent space of RANK dimensions; each task adds its part of the product that the
decomposition needs. The space's axes are scaled to equal weight. Every passage of every document is then compared with every benchmark item by the cosine in that space,
in blocks. Paraphrases and items much longer or shorter than a passage lie beyond any useful cosine, so the passages around
which enough of an item's rarest words occur (fewer would leave LESS of its words out of reach) are candidates as well: these
miss none that the rule below accepts. Candidates go on to a longest common subsequence of words around the passage, first on
the hashed numbers, then on the words themselves. An item is found in a document if the subsequence covers COVER of its words, or LESS of them with
the item's answer (a column ``answer``, or else its last ANSWER words) covered as well.

Defined cases: null and empty texts and items are found nowhere and hold nothing; a passage shorter than PASSAGE words is
compared as it is; items of fewer than SHORT words must be covered wholly; repeated rows give one pair; rows with a null
doc_id or item_id give pairs with null; extra columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import last_kept, small_batches, staged, text_hash
from .tokens import forget

PASSAGE, HALF = 32, 16
VOCABULARY, RANK, SKETCH = 1 << 14, 128, 144
#: The benchmark's passages weigh as much as this share of the documents', so that the space tells items apart.
WEIGHT = 0.065
#: Least cosine of a candidate; COVER, LESS: shares of an item's words; answers and short items in words.
COSINE, COVER, LESS, ANSWER, SHORT = 0.6, 0.8, 0.6, 8, 8
ITEMS_AT_ONCE = 10_000
#: Items, and occurrences of their rare words, that are counted at once.
ITEMS_COUNTED, COUNTED = 64, 1_000_000


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number in them of each word of the texts in a row, and the number of words of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    flat = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(flat)
    coded = lists.flatten().dictionary_encode()
    names = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\pL\pN]+", "")
    filled = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
    at = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    use = filled[at] if len(names) else np.zeros(0, bool)
    return names, at[use], np.bincount(row[use], minlength=len(texts))


def hashed(names: pa.Array) -> np.ndarray:
    """16-bit numbers of words; the latent space uses the low bits of them."""
    if not len(names):
        return np.zeros(0, np.uint16)
    return (pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False) >> np.uint64(20)).astype(np.uint16)


def word_numbers(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns ``more``, and the numbers of the text's words (binary, 16 bits each) as w."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                names, where, sizes = words(batch.column("text"))
                numbers = hashed(names)[where] if len(names) else np.zeros(0, np.uint16)
                ends = np.cumsum(sizes)
                coded = pa.array([numbers[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(batch.column, ["doc_id", *more]), coded], ["doc_id", *more, "w"])

    of_more = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in more)
    return docs.select("doc_id", "text", *[c for c in more if c != "text"]).mapInArrow(run, f"doc_id {id_type}, {of_more}w binary")


def stored(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(data.as_py(), np.uint16) for data in batch.column("w"))


def chunks(texts: Iterable[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Parts of a batch of word numbers with a quarter of a million words each, or one longer document: first row, and arrays."""
    part: list[np.ndarray] = []
    first = size = 0
    for i, data in enumerate(texts):
        part.append(data)
        size += len(part[-1])
        if size > 250_000:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def halves(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers in a row, where each half passage begins, and the row of each half passage."""
    sizes = np.array([len(p) for p in parts])
    n = -(-sizes // HALF)
    row = np.repeat(np.arange(len(parts)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16), (np.cumsum(sizes) - sizes)[row] + place * HALF, row


def document_frequencies(numbers: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages each number occurs, and the number of passages. VOCABULARY sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(VOCABULARY, np.int64), 0
        for batch in batches:
            for _, parts in chunks(stored(batch)):
                flat, starts, _ = halves(parts)
                if not len(flat):
                    continue
                of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(flat)))
                seen = np.sort(of.astype(np.uint32) * np.uint32(VOCABULARY) + (flat & (VOCABULARY - 1)))
                new = np.ones(len(seen), bool)
                new[1:] = seen[1:] != seen[:-1]
                total += np.bincount(seen[new] & np.uint32(VOCABULARY - 1), minlength=VOCABULARY)
                passages += len(starts)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *there], pa.int64()), pa.array([passages, *total[there]], pa.int64())], ["w", "n"])

    out, n = np.zeros(VOCABULARY), 0
    for k, m in numbers.select("w").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n")).collect():
        if k < 0:
            n = m
        else:
            out[k] = m
    return out, n


def random_matrix() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((VOCABULARY, SKETCH), np.float32)


def in_rows(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half passages as columns of HALF words of the space's vocabulary, the last one of a document filled up with none
    (VOCABULARY), and the half passage of each word."""
    of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(flat)))
    numbered = np.full((HALF, len(starts)), VOCABULARY, np.int64)
    numbered[np.arange(len(flat)) - starts[of], of] = flat & (VOCABULARY - 1)
    return numbered, of


def summed_rows(table: np.ndarray, numbered: np.ndarray) -> np.ndarray:
    """For each column of ``numbered`` the sum of the table's rows with the numbers in it."""
    out = np.take(table, numbered[0], axis=0, mode="clip")
    for k in range(1, len(numbered)):
        out += np.take(table, numbered[k], axis=0, mode="clip")
    return out


def sums_by(values: np.ndarray, rows: np.ndarray, keys: np.ndarray, run: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys``, and for each the sum of the ``values`` at its ``rows``. Runs of a key of at most ``run`` rows are
    added side by side, then the sums of the runs in the same way."""
    while True:
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        n = np.diff(first, append=len(keys))
        pieces = -(-n // run)
        within = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * run
        begin, count = np.repeat(first, pieces) + within, np.minimum(run, np.repeat(n, pieces) - within)
        longest = np.argsort(-count, kind="stable")
        begin, count = begin[longest], count[longest]
        out = np.take(values, rows[begin], axis=0, mode="clip")
        for k in range(1, int(count.max(initial=0))):
            m = int(np.searchsorted(-count, -k, "left"))  # those with more than k rows
            out[:m] += np.take(values, rows[begin[:m] + k], axis=0, mode="clip")
        keys = keys[begin]
        if len(keys) == len(first):
            return keys, out
        values, rows = out, np.arange(len(keys))


def latent_space(numbers: DataFrame, idf: np.ndarray, items: DataFrame, weight: float) -> np.ndarray:
    """The projection to the latent space, one row for each number, fitted on all passages of ``numbers`` (word_numbers) and
    of ``items``: the benchmark's, whose passages are of ``weight``."""
    idf = idf.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Passages are unit vectors: words are weighted by idf in the factor here, and once more when all is added.
        omega, total, square = np.vstack([random_matrix() * idf[:, None], np.zeros((1, SKETCH), np.float32)]), np.zeros((VOCABULARY, SKETCH)), idf**2
        for batch in batches:
            for _, parts in chunks(stored(batch)):
                flat, starts, _ = halves(parts)
                for a in range(0, len(starts), 4096):
                    b = min(len(starts), a + 4096)
                    end = starts[b] if b < len(starts) else len(flat)
                    words_here = flat[starts[a] : end] & (VOCABULARY - 1)
                    numbered, of = in_rows(words_here, starts[a:b] - starts[a])
                    y = summed_rows(omega, numbered)
                    y /= np.maximum(np.add.reduceat(square[words_here], starts[a:b] - starts[a]), 1e-12)[:, None]
                    name, sums = sums_by(y, of, words_here)
                    total[name] += sums
        total *= idf[:, None]
        blocks = total.astype(np.float32).reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "z"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [group["block"].iloc[0]], "z": [sum(np.frombuffer(z, np.float32) for z in group["z"]).astype(np.float32).tobytes()]})

    # A task adds up the product of many files' rows, as each sends a matrix: a few tasks for each core, each of which reads
    # its rows one batch after the other.
    tasks = max(16, 3 * numbers.sparkSession.sparkContext.defaultParallelism)
    total = np.zeros((64, VOCABULARY // 64, SKETCH), np.float32)
    for rows, each in ((items, weight), (numbers, 1.0)):
        for r in rows.select("w").coalesce(tasks).mapInArrow(run, "block int, z binary").groupBy("block").applyInPandas(added, "block int, z binary").toLocalIterator():  # 64 blocks of fixed size
            total[r["block"]] += np.float32(each) * np.frombuffer(r["z"], np.float32).reshape(total.shape[1:])
    # The rest takes blocks one by one, so that the driver holds no second matrix of doubles.
    core = sum(o.T.astype(float) @ t for o, t in zip(random_matrix().reshape(total.shape), total, strict=True))
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 1e-12) * 1e-9
    half = total @ (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
    # The singular values of the half and its right side, by its products.
    squares, right = np.linalg.eigh(sum(h.T.astype(float) @ h for h in half))
    squares, right = np.maximum(squares[::-1][:RANK], 1e-18), right[:, ::-1][:, :RANK]
    return (half @ (right / squares).astype(np.float32)).reshape(VOCABULARY, -1)


def common(a: list, b: list) -> int:
    """The length of the longest common subsequence (bit-parallel)."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def covered(item: list, answer: list, segment: list) -> tuple[float, bool, bool]:
    """The share of the item in the segment, whether the answer is in it, and whether that makes a find."""
    there = set(segment)
    if sum(map(there.__contains__, item)) < LESS * len(item):  # no subsequence can be longer
        return 0.0, False, False
    share = common(item, segment) / len(item)
    if share < LESS:
        return share, False, False
    found = bool(answer) and common(answer, segment) >= COVER * len(answer)
    return share, found, share >= (1 if len(item) < SHORT else COVER) or (len(item) >= SHORT and found)


def around(start: int, length: int, size: int) -> tuple[int, int]:
    """The words of a document compared with an item of ``length`` words at a passage that begins at ``start``."""
    return max(0, start - length), min(size, start + PASSAGE + length)


def needed(size: int) -> int:
    """How many of an item's ``size`` words must be around a passage at least (no subsequence is longer)."""
    share = 1 if size < SHORT else LESS
    return max(1, next(n for n in range(size + 1) if n >= share * size - 1e-6))


class Rare:
    """Finds the passages around which enough of the rarest words of items occur."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray):
        sizes = np.array([len(w) for w in items])
        need = np.array([needed(n) for n in sizes.tolist()])
        self.sizes = sizes
        #: The words compared at a passage, in whole half passages.
        self.halves = -(-(PASSAGE + 2 * sizes) // HALF)
        # Of the size - need + least rarest words at least ``least`` must be there.
        self.least = np.maximum(1, -(-need // 2))
        self.groups = []
        for first in range(0, len(items), ITEMS_COUNTED):
            listed = []
            for k in range(first, min(len(items), first + ITEMS_COUNTED)):
                rarest = items[k][np.argsort(-idf[items[k] & (VOCABULARY - 1)], kind="stable")][: sizes[k] - need[k] + self.least[k]]
                word, times = np.unique(rarest, return_counts=True)
                listed.append((word.astype(np.int64), np.full(len(word), k), times))
            word, item, times = (np.concatenate(x) for x in zip(*listed, strict=True))
            order = np.argsort(word, kind="stable")
            count = np.bincount(word, minlength=1 << 16)
            # Of each word its places in the lists of the items, one list after the other.
            self.groups.append((count, np.cumsum(count) - count, order, item, times))

    def passages(self, parts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """Document, item, and the first and last + 1 of the half passages at which passages may begin."""
        flat = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        n = -(-sizes // HALF)
        first_half = np.cumsum(n) - n
        row = np.repeat(np.arange(len(parts)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for count, first, places, items, times in self.groups:
            many = count[flat]
            at = np.flatnonzero(many)
            many = many[at]
            ends = np.cumsum(many)
            begin = 0
            while begin < len(at):
                # Whole documents, one at least.
                end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + COUNTED, "right"))
                if end < len(at):
                    whole = int(np.searchsorted(row[at], row[at[end]]))
                    end = whole if whole > begin else int(np.searchsorted(row[at], row[at[end]], "right"))
                some, k = at[begin:end], many[begin:end]
                begin = end
                post = np.repeat(first[flat[some]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                listed, occurrence = places[post], np.repeat(some, k)
                which = items[listed]
                # What is compared begins in a stretch of as many halves as it is long, so it ends in the next one.
                long = self.halves[which]
                stretch = (place[occurrence] + self.sizes[which]) // (HALF * long)
                doc = row[occurrence]
                keys = []
                for back in (0, 1):
                    start = (stretch - back) * long
                    use = (start >= 0) & (start < n[doc])
                    keys.append((first_half[doc[use]] + start[use]) * len(items) + listed[use])
                # Each word of an item counts once in a stretch.
                key = np.sort(np.concatenate(keys))
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                half, listed = np.divmod(key[new], len(items))
                if not len(half):
                    continue
                which = items[listed]
                new = np.ones(len(half), bool)
                new[1:] = (half[1:] != half[:-1]) | (which[1:] != which[:-1])
                new = np.flatnonzero(new)
                enough = new[np.add.reduceat(times[listed], new) >= self.least[which[new]]]
                for half_at, item in zip(half[enough].tolist(), which[enough].tolist(), strict=True):
                    doc_at = int(np.searchsorted(first_half, half_at, "right")) - 1
                    half_at -= int(first_half[doc_at])
                    yield doc_at, item, half_at, min(int(n[doc_at]), half_at + int(self.halves[item]))


def retrieved(numbers: DataFrame, items: list[tuple[object, np.ndarray, np.ndarray]], plain: list[tuple[list, list]], idf: np.ndarray, space: np.ndarray, item_type: DataType, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, share, answer_found and the text's hash (__x) of what is found at each passage of ``numbers``
    (word_numbers with text and __x). ``plain``: the items' and answers' words. Texts lie beside their numbers, so that no join
    has to bring them along; only those in which the numbers show an item are cut into words again."""
    id_type = numbers.schema["doc_id"].dataType.simpleString()
    weighted = np.vstack([space * idf.astype(np.float32)[:, None], np.zeros((1, space.shape[1]), np.float32)])  # the last row: no word

    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    queries = unit(np.array([summed_rows(weighted, (w & (VOCABULARY - 1))[:, None])[0] for _, w, _ in items], np.float32)).T
    lists = [(w.tolist(), a.tolist()) for _, w, a in items]
    rare = Rare([w for _, w, _ in items], idf)
    kind = to_arrow_type(item_type)
    need = [needed(len(w)) for w, _ in lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            numbered_texts = list(stored(batch))
            shown: list[tuple[int, int, int, int]] = []
            found: list[tuple[int, int, float, bool]] = []
            for first, parts in chunks(numbered_texts):
                flat, starts, row = halves(parts)
                if not len(flat):
                    continue
                sizes = np.array([len(p) for p in parts])
                begin = np.cumsum(sizes) - sizes
                compared: set[tuple[int, int, int]] = set()
                numbered, _ = in_rows(flat, starts)
                for a in range(0, len(starts), 4096):
                    b = min(len(starts), a + 4097)  # one half more, for the last passage
                    half = summed_rows(weighted, numbered[:, a:b])
                    whole = half.copy()
                    same = row[a : b - 1] == row[a + 1 : b]
                    whole[:-1][same] += half[1:][same]
                    n = min(4096, b - a)
                    # Where a document has a passage that begins before, its last half alone is part of that one.
                    hit, item = np.nonzero(unit(whole[:n]) @ queries >= cosine)
                    for h, k in zip(hit.tolist(), item.tolist(), strict=True):
                        r = int(row[a + h])
                        compared.add((r, k, int(starts[a + h] - begin[r])))
                for r, k, start, end in rare.passages(parts):
                    lo, hi = around(start * HALF, len(lists[k][0]), int(sizes[r]))[0], around((end - 1) * HALF, len(lists[k][0]), int(sizes[r]))[1]
                    there = set(parts[r][lo:hi].tolist())
                    if sum(map(there.__contains__, lists[k][0])) >= need[k]:
                        compared.update((r, k, at * HALF) for at in range(start, end))
                for r, k, start in sorted(compared):
                    lo, hi = around(start, len(lists[k][0]), int(sizes[r]))
                    if covered(*lists[k], parts[r][lo:hi].tolist())[2]:
                        shown.append((first + r, k, lo, hi))
            if not shown:
                continue
            # The numbers of different words may be the same.
            rows = sorted({r for r, *_ in shown})
            names, where, lengths = words(batch.column("text").take(pa.array(rows)))
            begins = dict(zip(rows, (np.cumsum(lengths) - lengths).tolist(), strict=True))
            for r, k, lo, hi in shown:
                share, answer, hit = covered(*plain[k], names.take(pa.array(where[begins[r] + lo : begins[r] + hi])).to_pylist())
                if hit:
                    found.append((r, k, share, answer))
            if found:
                columns = [batch.column("doc_id").take(pa.array([f[0] for f in found])), pa.array([items[f[1]][0] for f in found], kind)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.bool_()), batch.column("__x").take(pa.array([f[0] for f in found]))], ["doc_id", "item_id", "share", "answer_found", "__x"])

    return numbers.select("doc_id", "text", "__x", "w").mapInArrow(run, f"doc_id {id_type}, item_id {item_type.simpleString()}, share double, answer_found boolean, __x long")


def finds(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, share, answer_found and the text's hash (__x) of all that is found, repeated rows among them."""
    small_batches(docs.sparkSession)
    numbers = staged(word_numbers(docs.withColumn("__x", text_hash()), "text", "__x"), "word-numbers")
    frequency, passages = document_frequencies(numbers)
    idf = np.log((1 + passages) / (1 + frequency)) + 1e-3
    has_answer = "answer" in benchmark.columns
    items_all = benchmark.select("item_id", "text", (F.col("answer") if has_answer else F.lit(None).cast("string")).alias("answer")).dropDuplicates()
    number = items_all.count()
    blocks = max(1, -(-number // ITEMS_AT_ONCE))
    space, out = None, None
    id_types = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {id_types[0]}, item_id {id_types[1]}, share double, answer_found boolean, __x long"
    for block in range(blocks):
        rows = items_all.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # about ITEMS_AT_ONCE
        items, plain = [], []
        for r in rows:
            names, at, _ = words(pa.array([r["text"]], pa.large_string()))
            answers, aat, _ = words(pa.array([r["answer"]], pa.large_string()))
            if len(at):
                mine = [names[int(i)].as_py() for i in at]
                answer = [answers[int(i)].as_py() for i in aat] or mine[-ANSWER:]
                items.append((r["item_id"], hashed(pa.array(mine, pa.large_string())), hashed(pa.array(answer, pa.large_string()))))
                plain.append((mine, answer))
        if not items:
            continue
        if space is None:
            every = word_numbers(items_all.select(F.col("item_id").alias("doc_id"), "text"))
            space = latent_space(numbers, idf, every, max(1.0, WEIGHT * passages / number))
        part = retrieved(numbers, items, plain, idf, space, benchmark.schema["item_id"].dataType, cosine)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row for each document and benchmark item found in it: doc_id, item_id, share (of the item's words, in order) and
    answer_found."""
    out = finds(docs, benchmark, cosine)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("answer_found").alias("answer_found"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns."""
    with last_kept(docs.sparkSession):
        bad = staged(finds(docs, benchmark).select(F.col("doc_id").alias("__d"), F.col("__x").alias("__y")).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__d")) & (text_hash() == F.col("__y")), "left_anti")
