"""Token ids of whole columns of texts, by the ``tokenizers`` library with a memory of words.

Prose repeats its words, so most of a tokenizer's work is repeated too. Texts are cut where the tokenizer itself always
cuts, each distinct piece is encoded once, and the pieces' ids are put together with numpy. Both pre-tokenizers in use
cut before a blank that follows or precedes something else than white space, and around a lone line feed; a text in which
white space characters adjoin, or one that spells a special token, is encoded as it is. The ids are those that
``Tokenizer.encode(text, add_special_tokens=False)`` gives for a tokenizer as loaded: special tokens spelled in a text become
their ids (tested on random texts).
"""

from __future__ import annotations

import os
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered by one Python worker; beyond this, others are encoded in each batch where they occur.
MEMORY = 500_000
MARK = "\x01"


class WordEncoder:
    """``encode(texts)`` gives all ids of the texts in a row and the number of ids of each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Byte-level vocabularies keep white space as ids; the others drop it, and need another piece between words.
        self.keeps_space = bool(self._plain("\n"))
        self.between = "\n" if self.keeps_space else " ` "
        self.ignores_case = self._plain("AZ") == self._plain("az")
        (self.between_id,) = self._plain(self.between)
        self.apart = r"\n|[\s\p{Z}\x0b\x1c-\x1f\x{85}]$|^[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]" if self.keeps_space else "`"
        spelled = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        odd = ([r"[\s\p{Z}\x0b\x1c-\x1f\x{85}][\s\p{Z}\x0b\x1c-\x1f\x{85}]|\x01"] if self.keeps_space else []) + ([f"(?i:{'|'.join(spelled)})"] if spelled else [])
        #: Texts that are encoded as they are.
        self.odd = "|".join(odd)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.known = 0
        self.parts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._learn([".", ","], self.index)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, pieces: list[str], index: dict[str, int]) -> None:
        """Encodes pieces and numbers them in ``index``. Some must not be encoded in a row with others: those with the
        separator in them, or white space at an end where it would join the separator's."""
        if not pieces:
            return
        apart = pc.match_substring_regex(pa.array(pieces, pa.large_string()), self.apart).to_numpy(zero_copy_only=False)
        together = [p for p, x in zip(pieces, apart, strict=True) if not x] if apart.any() else pieces
        alone = [p for p, x in zip(pieces, apart, strict=True) if x] if apart.any() else []
        for start in range(0, len(together), 1000):
            chunk = together[start : start + 1000]
            (got,) = self.tokenizer.encode_batch_fast([self.between.join(chunk) + self.between], add_special_tokens=False)
            ids = np.array(got.ids, dtype=np.int64)
            ends = np.flatnonzero(ids == self.between_id)
            if len(ends) != len(chunk):
                alone = alone + chunk
                continue
            self._add(chunk, np.delete(ids, ends), np.diff(ends, prepend=-1) - 1, index)
        if alone:
            each = [np.array(self._plain(p), dtype=np.int64) for p in alone]
            self._add(alone, np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64), index)

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray, index: dict[str, int]) -> None:
        index.update(zip(pieces, range(self.known, self.known + len(pieces)), strict=True))
        self.known += len(pieces)
        self.parts.append(ids.astype(np.uint16 if self.tokenizer.get_vocab_size() < 65_536 else np.uint32))
        self.sizes.append(sizes)
        self.table = None

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.table is None:
            ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
            sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
            self.parts, self.sizes = [ids], [sizes]
            self.table = ids, sizes, np.cumsum(sizes) - sizes
        return self.table

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each piece of the texts its number in the memory; for each text its number of pieces."""
        if self.keeps_space:
            marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK + " "), "\n", MARK + "\n" + MARK)
            lists = pc.split_pattern(marked, MARK)
        else:
            plain = pc.replace_substring(texts, "\n", " ")
            lists = pc.split_pattern(pc.ascii_lower(plain) if self.ignores_case else plain, " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        words = lists.flatten().dictionary_encode()
        # A full stop or comma after a letter or digit is a piece of its own to both pre-tokenizers.
        stop = pc.match_substring_regex(words.dictionary, r"[\pL\pN][.,]$")
        bare = pc.if_else(stop, pc.utf8_slice_codeunits(words.dictionary, 0, -1), words.dictionary).dictionary_encode()
        names = bare.dictionary.to_pylist()
        get = self.index.get
        numbers = np.array([get(w, -1) for w in names], dtype=np.int64)
        missing = np.flatnonzero(numbers < 0)
        new = [names[i] for i in missing]
        if self.known >= MEMORY and len(new) > len(names) / 2:  # other texts than those remembered
            self.clear()
            missing, new = np.arange(len(names)), names
        keep = self.index if self.known < MEMORY else {}
        self.passing = None if keep is self.index else (self.known,)
        self._learn([w for w in new if w], keep)
        numbers[missing] = [keep.get(w, -1) for w in new]
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(names):
            return np.zeros(0, np.int64), counts
        dots = pc.ends_with(words.dictionary, ".").to_numpy(zero_copy_only=False)
        pairs = np.full((len(words.dictionary), 2), -1, np.int64)
        pairs[:, 0] = numbers[bare.indices.to_numpy(zero_copy_only=False)]
        pairs[:, 1] = np.where(stop.to_numpy(zero_copy_only=False), np.where(dots, self.index["."], self.index[","]), -1)
        return pairs[words.indices.to_numpy(zero_copy_only=False)].reshape(-1), 2 * counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, self.odd) if self.odd else None
        slow = odd.to_numpy(zero_copy_only=False) if odd is not None else np.zeros(len(texts), bool)
        if slow.any():
            easy, sizes = self.encode_easy(pc.if_else(odd, "", texts))
            hard = [np.array(self._plain(texts[int(i)].as_py()), dtype=easy.dtype) for i in np.flatnonzero(slow)]
            ends = np.cumsum(sizes)
            out, at = [], 0
            for i, ids in zip(np.flatnonzero(slow), hard, strict=True):
                out += [easy[at : ends[i]], ids]
                at = ends[i]
                sizes[i] = len(ids)
            return np.concatenate([*out, easy[at:]]), sizes
        return self.encode_easy(texts)

    def encode_easy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        numbers, counts = self._pieces(texts)
        ids, sizes, starts = self._tables()
        if self.passing:  # what was encoded beside the full memory serves this call only
            known = self.passing[0]
            self.table = ids[: starts[known]] if known < len(starts) else ids, sizes[:known], starts[:known]
            self.parts, self.sizes, self.known = [self.table[0]], [self.table[1]], known
        blank = numbers < 0
        numbers = np.where(blank, 0, numbers)
        if not len(sizes):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        size = np.where(blank, 0, sizes[numbers])
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts[numbers] - (ends - size), size) + np.arange(total)
        of_text = np.concatenate([[0], ends])[np.cumsum(counts)]
        return ids[at], np.diff(of_text, prepend=0)


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and vocabulary file."""
    return WordEncoder(path)


def forget() -> None:
    """Frees the encoders of this Python worker, which Spark uses again for other work."""
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, as little-endian unsigned 32-bit integers, and the texts' new sizes."""
    out = np.empty(len(ids) + len(sizes), dtype="<u4")
    ends = np.cumsum(sizes + 1) - 1
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = end_id
    out[~is_end] = ids
    return out, sizes + 1


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
