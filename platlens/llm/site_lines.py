"""Lines that recur in too many documents of one source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import broadcast_if_small, cut, small
from .words import BatchWords, column, in_blocks, mix64

#: Counters that a task keeps at most before it hands its summary on.
COUNTERS = 500_000
_SUMMARY = pa.schema([("source", pa.string()), ("h", pa.int64()), ("n", pa.int64()), ("error", pa.int64())])


class _LineHashes:
    """64-bit hashes of the words of lines, many lines at once."""

    def __init__(self, least_words: int) -> None:
        self.least, self.words_of = least_words, BatchWords()

    def __call__(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, whether the line has enough words)."""
        codes, at = self.words_of(lines)
        n = np.diff(at)
        place = np.arange(len(codes), dtype=np.uint64) - np.repeat(at[:-1], n).astype(np.uint64)
        mixed = np.r_[mix64(codes ^ mix64(place + np.uint64(1))), np.zeros(1, dtype=np.uint64)]
        sums = np.add.reduceat(mixed, np.minimum(at[:-1], len(codes)))
        return mix64(sums + n.astype(np.uint64)).view(np.int64), n >= max(1, self.least)


def source_label(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))


class SiteLines:
    """Lines of the documents of a source that stand in at least `least_docs` documents and `share` of all its documents.

    chunks: doc, key (of a row), text. sources: doc, source; sources are compared trimmed and upper-cased, and of several
    names of one document the first in order counts. Lines are the pieces between line feeds, numbered from 0; those of
    fewer than `least_words` words never count, and two lines are the same if their words are. All documents of chunks that
    have a source make up its documents, also those without text.

    1. Of every row only hashes of its lines are kept; (document, line) pairs are made distinct across the cluster.
    2. Each task keeps Misra-Gries summaries per source. With m counters a summary misses at most n/m of n pairs; m is
       chosen from the counts of pairs and documents of the sources, so that no line that reaches the share can be lost.
       Summaries are merged by adding counts and errors; lines that may reach the share are the candidates.
    3. The candidates' documents are counted exactly in a second pass over the pairs.
    4. Confirmed lines number at most pairs / (share x documents) a source, whatever the size of the input; they are
       broadcast after their number has been checked, else joined.
    What several steps read (pairs, sizes of sources, candidates, confirmed lines) is kept, not made again.

    Rows with null document or text have no lines; documents with null or blank source are left out. Rows delivered twice
    count once. Empty tables give no rows. Lines are told apart by a 64-bit hash of their words.
    """

    def __init__(self, chunks: DataFrame, sources: DataFrame, doc: str = "doc_id", key: str = "chunk_id", text: str = "chunk_text", source_doc: str = "platform_id", source: str = "party", share: float = 0.2, least_docs: int = 3, least_words: int = 4) -> None:
        self.least_words, self.key, self.text_name = least_words, key, text
        self.rows = chunks.select(F.col(doc).alias("d"), F.col(key).alias("k"), F.col(text).alias("t")).where("d is not null")
        named = sources.select(F.col(source_doc).alias("d"), source_label(F.col(source)).alias("source")).where("d is not null and source <> ''")
        self.source_of = named.groupBy("d").agg(F.min("source").alias("source"))
        docs = self.rows.select("d").distinct().join(self.source_of, "d").groupBy("source").agg(F.count("*").alias("docs"))
        pairs = cut(self._lines(self.rows).select("d", "h").distinct().join(self.source_of, "d").select("source", "h"))
        sizes = cut(docs.join(pairs.groupBy("source").agg(F.count("*").alias("pairs")), "source"))
        need = sizes.agg(F.max(F.col("pairs") / (share * F.col("docs"))).alias("m")).first().m
        m = 2 * math.ceil(need or 1) + 16
        summed = cut(pairs.mapInArrow(_summarise(m), "source string, h bigint, n bigint, error bigint").groupBy("source", "h").agg(F.sum("n").alias("n"), F.sum("error").alias("error")))
        lost = summed.where("h is null").select("source", F.col("error").alias("lost"))
        likely = summed.where("h is not null").join(lost, "source", "left").join(sizes, "source")
        most = F.col("n") + F.coalesce("lost", F.lit(0))
        candidates = cut(likely.where((most >= least_docs) & (most >= share * F.col("docs") - 1e-9)).select("source", "h"))
        exact = pairs.join(broadcast_if_small(candidates), ["source", "h"], "left_semi").groupBy("source", "h").agg(F.count("*").alias("line_docs")).join(sizes.select("source", "docs"), "source")
        self.confirmed = cut(exact.where((F.col("line_docs") >= least_docs) & (F.col("line_docs") >= share * F.col("docs") - 1e-9)))

    def _lines(self, rows: DataFrame) -> DataFrame:
        """k, d, line_no and h of every line that is long enough."""
        least = self.least_words
        schema = rows.select("k", "d", F.lit(0).cast("bigint").alias("line_no"), F.lit(0).cast("bigint").alias("h")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = _LineHashes(least)
            for b in batches:
                texts = column(b, "t")
                for i, j in in_blocks(texts):
                    split = [t.split("\n") for t in texts[i:j]]
                    n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
                    row = np.repeat(np.arange(i, j), n)
                    line_no = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    h, ok = hashes([x for lines in split for x in lines])
                    at = pa.array(row[ok])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(line_no[ok]), pa.array(h[ok])], names=["k", "d", "line_no", "h"])

        return rows.where("t is not null").select("k", "d", "t").mapInArrow(run, schema)

    def occurrences(self) -> DataFrame:
        """Every place of a confirmed line in its source: key, line_no, source, line_docs, docs."""
        sure = broadcast_if_small(self.confirmed)
        some = broadcast_if_small(self.confirmed.select("h").distinct())
        hits = self._lines(self.rows).join(some, "h", "left_semi").distinct()
        found = hits.join(self.source_of, "d").join(sure, ["source", "h"])
        return found.select(F.col("k").alias(self.key), "line_no", "source", "line_docs", "docs").distinct()

    def cleaned(self) -> DataFrame:
        """Every row with a document, without the confirmed lines of its source: key, text, lines_removed. Null texts stay null.

        The confirmed lines of a source are one array, at most 5 times (1 / share) the lines of a mean document; the
        arrays are broadcast if all confirmed lines together are few, else joined.
        """
        sets = self.confirmed.groupBy("source").agg(F.collect_set("h").alias("bad"))
        sets = F.broadcast(sets) if small(self.confirmed) else sets
        least = self.least_words
        schema = self.rows.select("k", "d", "t", F.array().cast("array<bigint>").alias("hs")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = _LineHashes(least)
            for b in batches:
                texts = column(b, "t")
                for i, j in in_blocks([t or "" for t in texts]):
                    split = [t.split("\n") if t is not None else [] for t in texts[i:j]]
                    n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
                    h, ok = hashes([x for lines in split for x in lines])
                    hs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(h[: int(n.sum())], mask=~ok[: int(n.sum())]))
                    part = b.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), hs], names=["k", "d", "t", "hs"])

        rows = self.rows.select("k", "d", "t").mapInArrow(run, schema).join(self.source_of, "d", "left").join(sets, "source", "left")
        lines = F.split("t", "\n", -1)
        keep = lambda _, i: ~F.coalesce(F.array_contains(F.col("bad"), F.get(F.col("hs"), i)), F.lit(False))
        kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, keep))
        removed = F.when(F.col("t").isNull(), 0).otherwise(F.size(lines) - F.size(kept))
        return rows.select(F.col("k").alias(self.key), F.when(F.col("t").isNotNull(), F.array_join(kept, "\n")).alias(self.text_name), removed.alias("lines_removed"))


def _summarise(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, int]] = {}
        lost: dict[str, int] = {}
        held = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            rows = [(s, h, n, 0) for s, own in kept.items() for h, n in own.items()] + [(s, None, 0, e) for s, e in lost.items()]
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows[i : i + 50_000]), _SUMMARY)], schema=_SUMMARY)
            kept.clear()
            lost.clear()

        for b in batches:
            for s, h in zip(column(b, "source"), column(b, "h")):
                own = kept.setdefault(s, {})
                if h in own:
                    own[h] += 1
                    continue
                own[h] = 1
                held += 1
                if len(own) > 2 * m:  # keep the m largest counters, less the next
                    cut = sorted(own.values(), reverse=True)[m]
                    held -= len(own)
                    kept[s] = {x: n - cut for x, n in own.items() if n > cut}
                    held += len(kept[s])
                    lost[s] = lost.get(s, 0) + cut
            if held > COUNTERS:
                yield from hand_on()
                held = 0
        yield from hand_on()

    return run
