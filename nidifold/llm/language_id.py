"""Language identification by hierarchical discrimination: the family first, then its languages one against one.

A text is a vector of its letters' one-, two- and three-grams (hashed, over the whole text). Languages are merged into
families by the likeness of their mean vectors. Linear support vector machines, one for each pair of families, vote for the
family; those for each pair of languages within it vote for the language.

The machines are fitted on about ROWS_PER_LANGUAGE distinct labelled texts of each language, MOST_ROWS at most, chosen by a
hash of the text; all rows are predicted.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without a language are not learned from;
if nothing can be learned every text is ``und``; with one language it is predicted for all others; repeated rows are
predicted each; a null doc_id is not held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ROWS_PER_LANGUAGE, MOST_ROWS = 1_000, 50_000
BUCKETS = 2_048
#: Languages merge into one family while their mean vectors are this much alike, of the range between the least and the
#: most alike pair.
ALIKE = 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_tables: dict[str, np.ndarray] = {}


def letters(text: str) -> np.ndarray:
    """The code points of a text in lower case, 0 for other characters than letters, repeated zeros once."""
    if "lower" not in _tables:
        lower = np.zeros(1 << 16, np.uint32)
        for k in range(1 << 16):
            if not 0xD800 <= k < 0xE000 and chr(k).isalpha():
                lower[k] = ord(chr(k).lower()[0])
        _tables["lower"] = lower
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = _tables["lower"][np.minimum(codes, 0xFFFF)]
    if len(codes) and codes.max() >= 1 << 16:
        out = np.where(codes >= 1 << 16, [c if c >= 1 << 16 and chr(c).isalpha() else 0 for c in codes.tolist()], out)
    out = np.concatenate([[0], out, [0]]).astype(np.uint32)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, and whether each has a letter."""
    counts = np.zeros((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        c = letters(text or "").astype(np.uint32)
        if len(c) < 3:
            continue
        with np.errstate(over="ignore"):
            two = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)
            three = two[:-1] * np.uint32(0xC2B2AE3D) ^ c[2:] * np.uint32(0x27D4EB2F)
            grams = np.concatenate([c[1:-1] * np.uint32(0x165667B1), two, three])
            grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts[i] = np.bincount(grams >> np.uint32(32 - int(BUCKETS).bit_length() + 1), minlength=BUCKETS)
    counts = np.sqrt(counts)
    norm = np.linalg.norm(counts, axis=1, keepdims=True)
    return counts / np.maximum(norm, 1e-9), norm[:, 0] > 0


def machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 200) -> np.ndarray:
    """A linear support vector machine (squared hinge loss, both classes of equal weight) by accelerated gradient steps;
    the last weight is the intercept. ``y`` is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y = y.astype(x.dtype)  # one type throughout, or each product would copy x
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = v = np.zeros(x.shape[1], x.dtype)
    step, t = 1 / (1 + 4 * c), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * c * (x.T @ (share * y * slack)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def families(means: np.ndarray, alike: float = ALIKE) -> list[list[int]]:
    """Languages grouped by average-linkage clustering of their mean vectors, less what all have in common."""
    groups = [[k] for k in range(len(means))]
    if len(groups) < 3:
        return groups
    own = means - means.mean(axis=0)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    like = own @ own.T
    pairs = [like[a, b] for a, b in combinations(range(len(means)), 2)]
    least = min(pairs) + alike * (max(pairs) - min(pairs))
    while len(groups) > 2:
        score, a, b = max((np.mean([like[i, j] for i in groups[a] for j in groups[b]]), a, b) for a, b in combinations(range(len(groups)), 2))
        if score < least:
            break
        groups[a] += groups.pop(b)
    return sorted(sorted(g) for g in groups)


@dataclass
class Discriminator:
    languages: list[str]
    families: list[list[int]]
    between: dict[tuple[int, int], np.ndarray]
    within: dict[tuple[int, int], np.ndarray]

    @classmethod
    def fitted(cls, x: np.ndarray, names: list[str]) -> Discriminator:
        languages = sorted(set(names))
        which = np.array([languages.index(n) for n in names])
        means = np.array([x[which == k].mean(axis=0) for k in range(len(languages))]) if languages else np.zeros((0, BUCKETS))
        groups = families(means)
        of = {k: g for g, group in enumerate(groups) for k in group}
        family = np.array([of[k] for k in which])
        pair = lambda label, a, b: machine(x[(label == a) | (label == b)], np.where(label[(label == a) | (label == b)] == a, 1.0, -1.0))
        between = {(a, b): pair(family, a, b) for a, b in combinations(range(len(groups)), 2)}
        within = {(a, b): pair(which, a, b) for group in groups for a, b in combinations(group, 2)}
        return cls(languages, groups, between, within)

    @staticmethod
    def _winner(x: np.ndarray, choices: list[int], machines: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The choice with most won pairs (then the largest margins), and a score from its least margin."""
        if len(choices) == 1:
            return np.full(len(x), choices[0]), np.ones(len(x))
        wins, margins, least = (np.zeros((len(x), len(choices))) for _ in range(3))
        least += np.inf
        for (i, a), (j, b) in combinations(enumerate(choices), 2):
            w = machines[a, b].astype(x.dtype)
            z = x @ w[:-1] + w[-1]
            for k, s in ((i, z), (j, -z)):
                wins[:, k] += s > 0
                margins[:, k] += np.clip(s, -1, 1)
                least[:, k] = np.minimum(least[:, k], s)
        best = (wins * 4 * len(choices) + margins).argmax(axis=1)
        return np.array(choices)[best], 1 / (1 + np.exp(-np.clip(4 * least[np.arange(len(x)), best], -30, 30)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        x, there = vectors(texts)
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        family, sure = self._winner(x, list(range(len(self.families))), self.between)
        for g, group in enumerate(self.families):
            rows = np.flatnonzero((family == g) & there)
            if len(rows):
                language, more = self._winner(x[rows], group, self.within)
                scores[rows] = sure[rows] * more
                for i, k in zip(rows, language, strict=True):
                    names[i] = self.languages[k]
        return names, scores


def training_rows(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, most: int = MOST_ROWS) -> DataFrame:
    """text and lang of about ``per_language`` distinct texts of each language that are not held out, ``most`` at most."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").count().collect()  # a row for each language
    parts = 1 << 20
    share = F.create_map(*[x for r in sizes for x in (F.lit(r[0]), F.lit(min(parts, -(-parts * per_language // r[1]))))]) if sizes else F.lit(None)
    told = known.select("text", "lang", F.xxhash64("text", F.lit("language")).alias("__h"))
    chosen = told.filter(F.pmod("__h", F.lit(parts)) < share[F.col("lang")]) if sizes else told.limit(0)
    return chosen.dropDuplicates(["__h", "lang"]).orderBy("__h", "lang").limit(most).select("text", "lang")


def fitted(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> Discriminator:
    def to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x, there = vectors(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary()), batch.column("lang")], ["v", "lang"]).filter(pa.array(there))

    rows = training_rows(docs, per_language).mapInArrow(to_vectors, "v binary, lang string").collect()  # bounded, see training_rows
    x = np.array([np.frombuffer(r["v"], np.float16) for r in rows], np.float32).reshape(len(rows), BUCKETS)
    return Discriminator.fitted(x, [r["lang"] for r in rows])


def languages(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs``."""
    small_batches(docs.sparkSession)
    model = fitted(docs, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                names, scores = model.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
