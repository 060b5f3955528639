"""Words as the operators of this package understand them."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A word is a longest run of letters and digits after lower-casing.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of all runs of k consecutive words, in order; empty if there are fewer words."""
    n = len(codes) - k + 1
    if n <= 0:
        return codes[:0]
    out = codes[:n].copy()
    for j in range(1, k):
        out = mix64(out + _M3) ^ codes[j : j + n]
    return mix64(out)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def emit(rows: list[tuple], schema: pa.Schema, step: int = 50_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*part), schema)], schema=schema)


class BatchWords:
    """Words of many texts at once, as 64-bit codes, without making a string of each word.

    Characters are looked up in tables over all code points: whether they belong to words and, if `fold` is set, what is
    left of them without combining marks after canonical decomposition. A word's code is a polynomial of its characters.
    """

    DROP = np.uint32(0xFFFFFFFF)

    def __init__(self, fold: bool = False) -> None:
        n = sys.maxunicode + 1
        self.alnum = np.fromiter((chr(c).isalnum() for c in range(n)), dtype=bool, count=n)
        self.table = None
        if fold:
            table = np.arange(n, dtype=np.uint32)
            self.long = np.zeros(n, dtype=bool)
            self.long[0xAC00:0xD7A4] = True  # syllables of Hangul; ideographs and what lies beyond have nothing to fold
            for c in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xD7B0, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
                if unicodedata.decomposition(chr(c)) or unicodedata.combining(chr(c)):
                    left = [x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x)]
                    self.long[c] = len(left) > 1
                    table[c] = ord(left[0]) if left else self.DROP
            self.table = table
        self.powers = np.ones(64, dtype=np.uint64)
        self._grow(64)

    def _grow(self, most: int) -> None:
        self.powers = np.cumprod(np.r_[np.ones(1, dtype=np.uint64), np.full(most, 0x9E3779B97F4A7C15, dtype=np.uint64)], dtype=np.uint64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all words in order, offsets): the words of text i are codes[offsets[i] : offsets[i + 1]]."""
        lows = [t.lower() for t in texts]
        chars = np.frombuffer("\n".join(lows).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if self.table is not None and self.long[chars].any():  # rare: decompositions of several characters are spelled out
            lows = ["".join(c if c.isascii() or not self.long[ord(c)] else unicodedata.normalize("NFD", c) for c in t) for t in lows]
            chars = np.frombuffer("\n".join(lows).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum(np.fromiter(map(len, lows), dtype=np.int64, count=len(lows)) + 1) - 1
        if self.table is not None:
            chars = self.table[chars]
            kept = chars != self.DROP
            if not kept.all():
                ends = np.r_[0, np.cumsum(kept)][ends]
                chars = chars[kept]
        inside = np.concatenate([[False], self.alnum[chars], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
        lengths = stops - starts
        letters = chars[inside[1:-1]].astype(np.uint64)
        first = np.cumsum(lengths) - lengths
        if int(lengths.max()) >= len(self.powers):
            self._grow(2 * int(lengths.max()))
        place = np.arange(len(letters), dtype=np.int64) - np.repeat(first, lengths)
        codes = mix64(np.add.reduceat((letters + np.uint64(0x51)) * self.powers[place], first) ^ (lengths.astype(np.uint64) << np.uint64(48)))
        return codes, np.r_[0, np.searchsorted(starts, ends)]


def in_blocks(texts: list[str], most: int = 4_000_000):
    """Consecutive slices (from, to) of texts of about so many characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
