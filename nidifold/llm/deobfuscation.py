"""Noisy-channel restoring of disguised words: a Viterbi search of the characters that were meant, under a character
language model, through the lattice of what each written character may stand for.

The channel writes letters as other characters (leetspeak), repeats them, and puts gaps between them. So a run of equal
characters may stand for one or two letters, or for letters that the character resembles; and a gap may be dropped or be the
edge of a word, each at its cost. A stretch of spelled letters is thus cut into words by the model.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import forget

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the model: 0 the edge of a word, 1 to 26 the letters (without accents), 27 any other letter.
SYMBOLS = 28
# What a character may stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": LETTERS}
#: Costs of the channel: a character written for another one, each letter dropped from a run of equal ones, and a gap put
#: between the letters of a word.
SUBSTITUTED, DROPPED, GAP = 1.0, 0.3, 0.5
#: Letters beyond this many in a row are like this many.
MOST_EQUAL = 4


def _table() -> np.ndarray:
    """The symbol of each code point of the basic plane."""
    out = np.zeros(1 << 16, np.uint8)
    for k in range(1 << 16):
        if 0xD800 <= k < 0xE000 or not (c := chr(k)).isalpha():
            continue
        base = unicodedata.normalize("NFD", c)[0].lower()
        out[k] = LETTERS.index(base) + 1 if base in LETTERS else 27
    return out


_known: dict[str, np.ndarray] = {}


def symbols(text: str) -> np.ndarray:
    """The symbols of a text, with an edge before and after."""
    if "table" not in _known:
        _known["table"] = _table()
    codes = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "replace"), np.uint32)
    return _known["table"][np.minimum(codes, 0xFFFF)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all character trigrams of all texts; SYMBOLS ** 3 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            texts = [x for x in batch.column("text").to_pylist() if x]
            part, size = [], 0
            for k, text in enumerate(texts):
                part.append(text)
                size += len(text)
                if size > 500_000 or k + 1 == len(texts):
                    s = symbols("\n".join(part)).astype(np.int32)
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
                    part, size = [], 0
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["trigram", "n"])

    rows = docs.select("text").mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for k, n in rows:
        out[k] = n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative logarithms) of a character after two others, by counts mixed with those of shorter contexts."""
    one = counts.sum(axis=(0, 1)) + 1
    one = one / one.sum()
    two = counts.sum(axis=0) + 20 * one
    two = two / two.sum(axis=1, keepdims=True)
    three = counts + 5 * two[None]
    return -np.log(three / three.sum(axis=2, keepdims=True))


def lattice(written: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, or of gaps, what may be meant (a blank is the edge of a word), each with its cost."""
    out = []
    for run in re.finditer(r"[\s._\-]+|(.)\1*", written):
        char, n = run[1], len(run[0])
        if char is None:
            out.append([("", GAP), (" ", 0.0)])
            continue
        meant = [(c, SUBSTITUTED) for c in LEET.get(char, "")] + ([(char, 0.0)] if char.isalpha() else [])
        n = min(n, MOST_EQUAL)
        # A character that is no letter and stands for none is passed over.
        out.append([(c * k, cost * n + DROPPED * (n - k)) for c, cost in meant for k in range(1, min(n, 2) + 1)] or [("", 0.0)])
    return out


def restored(written: str, costs: np.ndarray) -> str:
    """What is most likely meant by a disguised word or spelled stretch (lower case; words with blanks between them)."""
    steps = lattice(written.lower())
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    numbers: dict[str, list[int]] = {}
    for choices in steps:
        then: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for state, cost in best.items():
            for text, more in choices:
                (a, b), total = state, cost + more
                if text not in numbers:
                    numbers[text] = [0] if text == " " else symbols(text)[1:-1].tolist()
                for s in numbers[text]:
                    total += costs[a, b, s]
                    a, b = b, s
                if (a, b) not in then or total < then[a, b]:
                    then[a, b], came[a, b] = total, (state, text)
        best = then
        back.append(came)
    state = min(best, key=lambda s: (best[s] + costs[s[0], s[1], 0], s))
    out = []
    for came in reversed(back):
        state, text = came[state]
        out.append(text)
    return " ".join("".join(reversed(out)).split())


_TWICE = "(?:" + "|".join(f"{c}{c}" for c in LETTERS) + ")"
#: A disguised word: letters next to characters that stand for letters, three equal letters in a row, or three letters that are
#: written twice.
DISGUISED = r"\pL[0-9@$!|+(*€]+\pL|^[0-9@$!|€*]+\pL|\pL[0-9@$€*]+$|" + "|".join(f"{c}{{3}}" for c in LETTERS) + f"|{_TWICE}.*{_TWICE}.*{_TWICE}"
#: Letters (or characters that stand for some) one by one, with gaps of up to three characters between them.
_CHAR = r"[\pL0-9@$!|€*]"
SPACED = rf"(?:^|[\s\"'(,;:])(?:{_CHAR}[\s._\-]{{1,3}}){{2,}}{_CHAR}(?:$|[\s.,;:!?\"')])"
_ONE = r"(?:[^\W_]|[@$!|€*])"
_SPACED = re.compile(rf"(?<![^\s\"'(,;:])(?:{_ONE}[\s._\-]{{1,3}}){{2,}}{_ONE}(?![^\s.,;:!?\"')])")


def spelled(text: str) -> list[str]:
    """Stretches of a text that spell words one character at a time, gaps included."""
    return [m[0] for m in _SPACED.finditer(text) if any(c.isalpha() for c in m[0])]


def joined(stretch: str) -> list[str]:
    """A spelled stretch without its gaps. Between blanks the first or last character may be a word of its own, so the rest is
    given as well."""
    word = re.sub(r"[\s._\-]", "", stretch)
    return [word, word[1:], word[:-1]] if re.search(r"\s", stretch) else [word]
