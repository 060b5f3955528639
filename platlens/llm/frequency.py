"""How often, and in how many documents, every distinct term occurs."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .words import column, emit

#: 64 heavy terms to a bigint column; eight columns.
HEAVY_MOST = 512


def _terms(text: str, stop: frozenset[str]) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    out = text.lower().split()
    return [t for t in out if t not in stop] if stop else out


def _heavy_terms(df: DataFrame, stop: frozenset[str], share: float, most: int) -> list[str]:
    """Terms whose share of all occurrences reaches `share`, by mergeable Misra-Gries summaries.

    A summary keeps k = 4/share counters, so it undercounts by at most a quarter of the share looked for.
    Which terms are found only steers the work: the counts are exact for any choice.
    """
    k = max(64, int(4 / share))
    schema = pa.schema([("term", pa.string()), ("n", pa.int64()), ("seen", pa.int64())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter[str] = Counter()
        seen = 0
        for b in batches:
            for t in column(b, "t"):
                own = _terms(t, stop)
                seen += len(own)
                kept.update(own)
                if len(kept) > 4 * k:
                    cut = sorted(kept.values(), reverse=True)[k]
                    kept = Counter({w: n - cut for w, n in kept.items() if n > cut})
        yield from emit([("", 0, seen), *((w, n, 0) for w, n in kept.most_common(k))], schema)

    found = df.mapInArrow(summarise, "term string, n bigint, seen bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    top = found.orderBy(F.col("term") != "", F.desc("n"), "term").limit(most + 1).collect()
    total = sum(r.seen for r in top if r.term == "")
    return [r.term for r in top if r.term != "" and r.n >= share * total * 0.75]


def term_frequencies(
    df: DataFrame,
    text: str = "tokens",
    doc: str = "doc_id",
    stop: tuple[str, ...] = ("eos",),
    rare_docs: int = 3,
    common_share: float = 0.4,
    heavy_share: float = 0.0005,
) -> DataFrame:
    """One row per distinct term: term, tf (occurrences), df (documents), docs (documents with any term), mark.

    Terms are the pieces between white space in Unicode form NFC, lower-cased; all rows of one document make
    one document, and equal rows count once. `mark` is rare (df < rare_docs), common (df > common_share of the
    documents with any term; rare goes first where both hold) or null.

    Heavy-light aggregation. Terms found heavy are broadcast; every task counts them exactly in a local array
    and notes those of a row in a bit set, so that only one bit set a document is shuffled for them. The light
    terms alone are shuffled as (term, document) pairs, combined before the shuffle, and none of them is frequent
    enough to skew it. The two count tables are united at the end.

    Nulls: a row with null text counts nowhere; rows with a null document make one document together. Empty or
    blank text has no terms. An empty table gives no rows. Other columns are ignored.
    """
    halt = frozenset(stop)
    rows = df.select(F.col(doc).cast("string").alias("d"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    heavy = _heavy_terms(rows.select("t"), halt, heavy_share, HEAVY_MOST)
    at = {w: i for i, w in enumerate(heavy)}
    wide = max(1, (len(heavy) + 63) // 64)
    bits = [f"w{i}" for i in range(wide)]
    schema = pa.schema([("kind", pa.int8()), ("term", pa.string()), ("d", pa.string()), ("n", pa.int64()), *((b, pa.int64()) for b in bits)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.zeros(len(at), dtype=np.int64)
        none = (0,) * wide
        for b in batches:
            out: list[tuple] = []
            for d, t in zip(column(b, "d"), column(b, "t")):
                own = Counter(_terms(t, halt))
                if not own:
                    continue
                mask = [0] * wide
                for w, n in own.items():
                    i = at.get(w)
                    if i is None:
                        out.append((0, w, d, n, *none))
                    else:
                        exact[i] += n
                        mask[i >> 6] |= 1 << (i & 63)
                out.append((1, None, d, 0, *(m - (1 << 64) if m >> 63 else m for m in mask)))
            yield from emit(out, schema)
        yield from emit([(2, w, None, int(exact[i]), *none) for w, i in at.items() if exact[i]], schema)

    parts = (
        rows.distinct()
        .mapInArrow(count, "kind tinyint, term string, d string, n bigint, " + ", ".join(f"{b} bigint" for b in bits))
        .groupBy("kind", "term", "d")
        .agg(F.sum("n").alias("n"), *(F.bit_or(b).alias(b) for b in bits))
    )

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Light pairs and heavy counts pass as (term, tf, df); bit sets are counted, and documents under a null term."""
        exact = np.zeros(64 * wide, dtype=np.int64)
        docs = 0
        for b in batches:
            kind = b.column(0).to_numpy()
            sets = pa.array(kind == 1)
            own = b.filter(sets)
            docs += len(own)
            w = np.column_stack([own.column(3 + i).to_numpy() for i in range(wide)]).astype("<i8")
            exact += np.unpackbits(w.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            rest = b.filter(pa.array(kind != 1))
            yield pa.RecordBatch.from_arrays([rest.column(1), rest.column(2), pa.array((kind[kind != 1] == 0).astype(np.int64))], schema=counts)
        yield from emit([(None, 0, docs), *((w, 0, int(exact[i])) for w, i in at.items() if exact[i])], counts)

    counts = pa.schema([("term", pa.string()), ("tf", pa.int64()), ("df", pa.int64())])
    # Kept, as it is small and the number of documents is read from it before the terms are.
    counted = cut(
        parts.select("kind", "term", "n", *bits)
        .mapInArrow(unite, "term string, tf bigint, df bigint")
        .groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    )
    docs = counted.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("docs")).first().docs
    return counted.where("term is not null").withColumn("docs", F.lit(docs).cast("bigint")).withColumn(
        "mark", F.when(F.col("df") < rare_docs, F.lit("rare")).when(F.col("df") > common_share * F.col("docs"), F.lit("common"))
    )
