"""Toxicity scores of restored texts.

Words written in disguise (leetspeak, spacing, repetition) are restored by a noisy channel under a character trigram
model counted over all texts (see deobfuscation). A text's features are its words, plain and restored, and their beginnings
of four to seven letters, each with how many of the text's distinct words share it (at least one, two, three); a logistic
regression over those features that training rows show to matter gives the score.

The regression is fitted on all labelled rows that are not held out, one of each doc_id, near copies counted once (rows that
share one of two MinHash bands of five minima), by Spark's own solver, so no row reaches the driver. The model has at most
MOST_FEATURES features. Everything else covers all rows.

Defined cases: a null or empty text has no features and gets the score of the intercept; labels that are null are not
learned from; a doc_id labelled twice is toxic if one label says so; without labels of both kinds every score is 0; repeated
rows are scored each; a null doc_id is not held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import deobfuscation as deob
from .common import last_kept, small_batches, staged, text_hash, without
from .near_dedup import MIX, minima, mixed, shingle_sets
from .tokens import forget

#: Features kept for the regression: those in so many toxic training rows at least, by the strongest evidence.
LEAST_ROWS, MOST_FEATURES = 4, 5_000
#: Slots (of the leading bits of features) that tell which features are frequent enough; at most these reach the driver.
SLOTS = 1 << 20
SHIFT = np.uint64(64 - SLOTS.bit_length() + 1)
#: Rows of features that a task of the solver takes, about, and the weight of the squared weights.
ROWS_AT_ONCE, L2 = 20_000, 0.2
#: Tells features for more words from those for fewer.
COUNTED = np.uint64(0x165667B19E3779F9)
#: A word's features: the word itself and its beginnings of these lengths, and up to how many distinct words are counted.
BEGINNINGS, MOST_WORDS = (4, 5, 6, 7), 3


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


class Features:
    """Distinct features (64-bit hashes) of texts; remembers the restored forms of disguised words."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.memory = costs, {}

    def restore(self, word: str) -> str:
        if word not in self.memory:
            if len(self.memory) > 200_000:
                self.memory.clear()
            self.memory[word] = deob.restored(word, self.costs)
        return self.memory[word]

    def of_words(self, words: pa.Array) -> np.ndarray:
        """For each word (0: none) its own hash and those of its beginnings."""
        out = np.zeros((len(words), 1 + len(BEGINNINGS)), np.uint64)
        if len(words):
            size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
            for k, n in enumerate((0, *BEGINNINGS)):
                part = pc.utf8_slice_codeunits(words, 0, n) if n else words
                h = pd.util.hash_array(part.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)
                out[:, k] = np.where(size > n, h ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1), 0)
        return out

    def of_texts(self, texts: pa.Array, wanted: np.ndarray | None = None, bases: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and features, each pair once; only ``wanted`` features (sorted), made of ``bases``, if given."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        flat = texts
        for space in "\t\n\x0b\x0c\r":
            flat = pc.replace_substring(flat, space, " ")
        lists = pc.split_pattern(flat, " ")
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = coded.indices.to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(coded.dictionary)
        plain = pc.replace_substring_regex(lower, r"[^\pL]+", "")
        # Stars on both sides are emphasis; a single one at the end may be a letter.
        core = pc.replace_substring_regex(lower, r"^\*+([^*]+)\*+([^\pL*]*)$", r"\1\2")
        core = pc.replace_substring_regex(core, r"^[^\pL0-9@$€!|*]+|^[!|*$@€]{2,}|[^\pL0-9@$€*]+$|[$@€*]{2,}[^\pL]*$", "")
        odd = np.flatnonzero(pc.match_substring_regex(core, deob.DISGUISED).to_numpy(zero_copy_only=False))
        parts = [self.restore(w).split() or [""] for w in core.take(pa.array(odd)).to_pylist()]
        odd = np.repeat(odd, [len(p) for p in parts]) if parts else odd
        restored = [w for p in parts for w in p]
        spelt_row, spelt = [], []
        for i in np.flatnonzero(pc.match_substring_regex(texts, deob.SPACED).to_numpy(zero_copy_only=False)):
            words = []
            for stretch in deob.spelled(texts[int(i)].as_py().lower()):
                words += self.restore(stretch).split()
                words += [self.restore(w) for w in deob.joined(stretch)]
            spelt += words
            spelt_row += [i] * len(words)
        every = pa.concat_arrays([plain, pa.array([*restored, *spelt], pa.large_string())])
        base = self.of_words(every)
        base[pc.equal(every, "").to_numpy(zero_copy_only=False)] = 0
        # Written words stand for themselves and, in disguise, for the restored ones; spelt words come with their rows.
        of, word = np.concatenate([np.arange(len(plain)), odd]), np.arange(len(plain) + len(odd))
        use = base[word] != 0 if bases is None else np.isin(base[word], bases)
        order = np.argsort(of, kind="stable")
        of, word, use = of[order], word[order], use[order].any(axis=1)
        of, word = of[use], word[use]
        n = np.bincount(of, minlength=len(plain))
        first, times = np.cumsum(n) - n, n[at] if len(plain) else np.zeros(0, np.int64)
        place = np.repeat(first[at] - (np.cumsum(times) - times), times) + np.arange(times.sum()) if len(plain) else np.zeros(0, np.int64)
        rows = np.concatenate([np.repeat(row, times), np.array(spelt_row, np.int64)])
        words = np.concatenate([word[place], len(plain) + len(odd) + np.arange(len(spelt))])
        rows, words = np.repeat(rows, base.shape[1]), base[words].reshape(-1, base.shape[1])
        own, feature = np.repeat(words[:, 0], base.shape[1]), words.reshape(-1)
        use = feature != 0 if bases is None else np.isin(feature, bases)
        rows, own, feature = rows[use], own[use], feature[use]
        # Distinct words by row and feature.
        order = np.lexsort((own, feature, rows))
        rows, own, feature = rows[order], own[order], feature[order]
        other = np.ones(len(rows), bool)
        other[1:] = (rows[1:] != rows[:-1]) | (feature[1:] != feature[:-1])
        new = other.copy()
        new[1:] |= own[1:] != own[:-1]
        starts = np.flatnonzero(other)
        distinct = np.add.reduceat(new.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        rows, feature = rows[starts], feature[starts]
        with np.errstate(over="ignore"):
            parts = [(rows[distinct > k], feature[distinct > k] + COUNTED * np.uint64(k)) for k in range(MOST_WORDS)]
        rows, feature = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if wanted is not None:
            use = np.isin(feature, wanted)
            rows, feature = rows[use], feature[use]
        order = np.argsort(rows, kind="stable")
        return rows[order], feature[order]


def bases_of(wanted: np.ndarray) -> np.ndarray:
    """What the wanted features may be made of."""
    with np.errstate(over="ignore"):
        return np.unique(np.concatenate([wanted - COUNTED * np.uint64(k) for k in range(MOST_WORDS)]))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and label of all labelled rows that are not held out, one of each doc_id (the text of the least hash), near copies
    once. Texts are shuffled once, after what is to be learned from is known by marks alone."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                values, sizes = shingle_sets(batch.column("text"), 2)
                low = minima(values, sizes, 0, 10).astype(np.uint64)
                least = np.tile(batch.column("__own").to_numpy(zero_copy_only=False), (2, 1))  # an empty text is like no other
                for k in range(2):
                    mark = np.zeros(len(low), np.uint64)
                    with np.errstate(over="ignore"):
                        for j in range(5):
                            mark = mixed(mark * MIX + low[:, 5 * k + j])
                    least[k, sizes > 0] = (mark >> np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__x"), pa.array(least[0], pa.int64()), pa.array(least[1], pa.int64())], ["doc_id", "__x", "m0", "m1"])

    learnable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    some = labels.filter(learnable & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    texts = docs.filter(learnable).select("doc_id", "text", text_hash().alias("__x"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    marks = texts.withColumn("__own", F.xxhash64("doc_id")).mapInArrow(marked, f"doc_id {id_type}, __x long, m0 long, m1 long")
    each = marks.groupBy("doc_id").agg(F.min(F.struct("__x", "m0", "m1")).alias("m")).join(some, "doc_id").select("doc_id", "m.*", "label")
    # Near copies once.
    first = lambda rows, mark, *columns: rows.groupBy(mark, "label").agg(F.min_by(F.struct("doc_id", *columns), F.struct(F.xxhash64("doc_id"), "doc_id")).alias("o")).select("label", "o.*")
    chosen = staged(first(first(each, "m0", "__x", "m1"), "m1", "__x"), "toxicity-rows")
    return texts.groupBy("doc_id", "__x").agg(F.min("text").alias("text")).join(chosen, ["doc_id", "__x"]).select("text", "label")


def learned(docs: DataFrame, labels: DataFrame, costs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, sorted features and their weights."""
    rows = staged(training_rows(docs, labels), "toxicity-training")
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return (-30.0 if not sizes.get(1.0) else 0.0), np.zeros(0, np.uint64), np.zeros(0)
    bad, good = sizes[1.0], sizes[0.0]

    def counts(rows: DataFrame, name: str, slots: np.ndarray | None = None) -> DataFrame:
        """In how many rows each feature is; only features in ``slots``, if given."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = Features(costs)
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    _, found = make.of_texts(whole.slice(at, 500).column("text"))
                    if slots is not None:
                        found = found[slots[(found >> SHIFT).astype(np.int64)]]
                    feature, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(n, pa.int64())], ["f", "n"])

        return rows.mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias(name))

    # Features that are in enough toxic rows are counted in the others.
    frequent = staged(counts(rows.filter("label = 1"), "k").filter(F.col("k") >= LEAST_ROWS), "toxicity-features")
    slots = np.zeros(SLOTS, bool)
    for r in frequent.select(F.shiftrightunsigned("f", int(SHIFT)).cast("int").alias("s")).distinct().toLocalIterator():  # SLOTS at most
        slots[r[0]] = True
    every = frequent.join(counts(rows.filter("label = 0"), "q", slots), "f", "left").select("f", F.col("k").cast("double"), F.coalesce("q", F.lit(0)).cast("double").alias("q"))
    odds = F.log((F.col("k") + 0.5) / (bad + 1)) - F.log((F.col("q") + 0.5) / (good + 1))
    evidence = odds / F.sqrt(1 / (F.col("k") + 0.5) + 1 / (F.col("q") + 0.5))
    chosen = every.filter(odds > 1).select("f", evidence.alias("e")).orderBy(F.desc("e"), "f").limit(MOST_FEATURES)
    wanted = np.sort(np.array([r[0] for r in chosen.collect()], np.int64).view(np.uint64))
    if not len(wanted):
        return float(np.log(bad / good)), wanted, np.zeros(0)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, bases = Features(costs), bases_of(wanted)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                row, found = make.of_texts(batch.column("text"), wanted, bases)
                n = np.bincount(row, minlength=batch.num_rows)
                columns = pa.array(np.searchsorted(wanted, found).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), columns), batch.column("label")], ["f", "label"])

    picked = staged(rows.mapInArrow(pick, "f array<int>, label double"), "toxicity-picked")
    width = len(wanted)
    vector = F.udf(lambda f: Vectors.sparse(width, sorted(f), [1.0] * len(f)), VectorUDT())
    instances = picked.coalesce(-(-(bad + good) // ROWS_AT_ONCE)).select(vector("f").alias("features"), "label")
    # Spark's loss is a mean over the rows, the penalty is not.
    fitted = LogisticRegression(regParam=L2 / (bad + good), standardization=False, maxIter=200, tol=1e-8).fit(instances)
    return fitted.intercept, wanted, fitted.coefficients.toArray()


def scores(docs: DataFrame, labels: DataFrame, with_hash: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``; the text's hash as __x, if wanted."""
    small_batches(docs.sparkSession)
    costs = deob.model(deob.trigram_counts(docs))
    bias, wanted, weights = learned(docs, labels, costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        make, bases = Features(costs), bases_of(wanted)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                z = np.full(batch.num_rows, bias)
                if len(wanted):
                    rows, found = make.of_texts(batch.column("text"), wanted, bases)
                    z += np.bincount(rows, weights[np.searchsorted(wanted, found)], minlength=batch.num_rows)
                more = ["__x"] if with_hash else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64()), *map(batch.column, more)], ["doc_id", "held_out", "score", *more])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = [text_hash().alias("__x")] if with_hash else []
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", *columns).mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double{', __x long' if with_hash else ''}")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns."""
    with last_kept(docs.sparkSession):
        bad = staged(scores(docs, labels, with_hash=True).filter("predicted = 1").select("doc_id", "__x").distinct(), "toxic")
    return without(docs, [F.col("doc_id"), text_hash()], bad)
