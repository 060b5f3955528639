"""Passages of held-out items within a corpus."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WORD, BatchWords, column, emit, in_blocks

#: Items beyond this number are taken in several passes, so that what is sent to the executors stays bounded.
ITEMS_A_PASS = 20_000



class _Folding(dict):
    """What str.translate puts for a character: its decomposition without combining marks; learnt as characters occur."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self[code] = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        return out


def plain_words(text: str, folding: _Folding | None = None) -> list[str]:
    low = text.lower()
    if not low.isascii():
        low = low.translate(folding if folding is not None else _Folding())
    return WORD.findall(low)


class _Probe:
    """Windows of all items, held by their rarest word."""

    def __init__(self, items: list[tuple[int, list[str]]], seen: dict[str, int], size: int) -> None:
        self.size = size
        self.by_prefix: dict[str, list[tuple[int, int, int]]] = {}
        self.items = dict(items)
        for item, words in items:
            for i in range(len(words) - size + 1):
                at = min(range(size), key=lambda j: (seen.get(words[i + j], 0), words[i + j]))
                self.by_prefix.setdefault(words[i + at], []).append((item, i, at))
        self.prefixes = self.by_prefix.keys()

    def find(self, words: list[str]) -> dict[int, tuple[int, int]]:
        """For every item with a common run of `size` words: the longest run and its first word's place in the text."""
        out: dict[int, tuple[int, int]] = {}
        if len(words) < self.size or self.prefixes.isdisjoint(words):
            return out
        known, size, n = self.by_prefix, self.size, len(words)
        for p, w in enumerate(words):
            for item, i, at in known.get(w, ()):
                s = p - at
                if s < 0 or s + size > n:  # positional bound: the window would not fit
                    continue
                own = self.items[item]
                if words[s : s + size] != own[i : i + size]:
                    continue
                e, k = s + size, i + size
                while e < n and k < len(own) and words[e] == own[k]:
                    e, k = e + 1, k + 1
                while s and i and words[s - 1] == own[i - 1]:
                    s, i = s - 1, i - 1
                if item not in out or e - s > out[item][0]:
                    out[item] = (e - s, s)
        return out


def leaked_passages(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """One row per document and item that have at least `size` consecutive words in common: doc, item, run_words (the
    longest run), run_start (its place in the document, in words), item_words, share (run_words / item_words).

    Prefix-filtered join. Every window of `size` words of an item is a set that a document must hold whole, so it must
    hold the window's rarest word; words are ordered by the number of documents that have them, counted over the whole
    corpus for the items' words. The windows are broadcast by that word. A document without any of these words is done
    with after one look; at each hit the window's place is bounded by the document's ends, and the words are compared.
    Items are taken ITEMS_A_PASS at a time: nothing broadcast grows beyond that.

    Words are compared without case and accents. Items shorter than `size` words cannot leak. Null texts, and items with
    null ids, are left out; documents with a null id are reported with a null id. Equal rows count once. Empty tables
    give no rows.
    """
    kind = {c: t for c, t in docs.dtypes}[doc]
    doc_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    texts = docs.select(F.col(doc).cast(kind if doc_type != pa.string() else "string").alias("d"), F.col(text).alias("t")).where("t is not null")
    kind = kind if doc_type != pa.string() else "string"
    wanted = items.select(F.col(item).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    schema = pa.schema([("d", doc_type), ("i", pa.int64()), ("run_words", pa.int64()), ("run_start", pa.int64()), ("item_words", pa.int64())])
    total, found = wanted.count(), None
    passes = max(1, -(-total // ITEMS_A_PASS))
    for k in range(passes):
        mine = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        own = [(r.i, w) for r in sorted(mine.collect(), key=lambda r: (r.i, r.t)) if len(w := plain_words(r.t)) >= size]
        # Texts of one item under several rows become items of their own, told apart by their place in the list.
        ids, listed = [i for i, _ in own], [(n, w) for n, (_, w) in enumerate(own)]
        vocabulary = frozenset(w for _, x in own for w in x)

        listed_words = sorted(vocabulary)

        def frequencies(batches: Iterator[pa.RecordBatch], listed_words=listed_words) -> Iterator[pa.RecordBatch]:
            words_of = BatchWords(fold=True)
            sought, _ = words_of(listed_words)
            order = np.argsort(sought)
            seen = np.zeros(len(sought), dtype=np.int64)
            for b in batches:
                held = column(b, "t")
                for i, j in in_blocks(held):
                    codes, at = words_of(held[i:j])
                    k = np.minimum(np.searchsorted(sought, codes, sorter=order), len(sought) - 1)
                    hit = np.flatnonzero(sought[order[k]] == codes)
                    pair = np.unique(np.stack([np.searchsorted(at, hit, side="right"), order[k[hit]]]), axis=1)
                    seen += np.bincount(pair[1], minlength=len(seen))
            yield from emit([(w, int(n)) for w, n in zip(listed_words, seen) if n], pa.schema([("w", pa.string()), ("n", pa.int64())]))

        counted = texts.select("t").mapInArrow(frequencies, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect() if own else []
        probe = _Probe(listed, {r.w: r.n for r in counted}, size)

        def search(batches: Iterator[pa.RecordBatch], probe=probe, ids=ids) -> Iterator[pa.RecordBatch]:
            words_of, fold = BatchWords(fold=True), _Folding()
            sought = np.sort(words_of(sorted(probe.prefixes))[0])
            for b in batches:
                out = []
                docs_, held = column(b, "d"), column(b, "t")
                for i, j in in_blocks(held):
                    codes, at = words_of(held[i:j])
                    if not len(sought) or not len(codes):
                        continue
                    k = np.minimum(np.searchsorted(sought, codes), len(sought) - 1)
                    hit = np.flatnonzero(sought[k] == codes)
                    for x in np.unique(np.searchsorted(at, hit, side="right") - 1):  # documents with a prefix word
                        for n, (run, place) in probe.find(plain_words(held[i + x], fold)).items():
                            out.append((docs_[i + x], ids[n], run, place, len(probe.items[n])))
                if out:
                    yield from emit(out, schema)

        part = texts.mapInArrow(search, f"d {kind}, i bigint, run_words bigint, run_start bigint, item_words bigint")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("d", "i").agg(F.max(F.struct("run_words", F.negative("run_start").alias("back"), "item_words")).alias("b"))
    return best.select(F.col("d").alias(doc), F.col("i").alias(item), "b.run_words", F.negative(F.col("b.back")).alias("run_start"), "b.item_words", (F.col("b.run_words") / F.col("b.item_words")).alias("share"))


def leak_report(passages: DataFrame, item: str = "item_id") -> DataFrame:
    """One row per leaked item: item, documents, longest share of it found in one run."""
    return passages.groupBy(item).agg(F.count("*").alias("documents"), F.max("share").alias("most_share"))
