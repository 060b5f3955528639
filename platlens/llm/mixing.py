"""Mixes of sources with target shares of the total size."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import column

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern by which this family of byte-pair vocabularies splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GOLDEN = 0.6180339887498949
#: Target sources are a parameter of the caller; more than this are refused.
MOST_SOURCES = 10_000
STRETCH = 65_536


def source_label(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


class TokenCounter:
    """Sizes of texts in tokens of a tiktoken vocabulary, or in pieces between white space if there is none."""

    def __init__(self, ranks: dict[bytes, int] | None) -> None:
        self.encoding = None
        if ranks is not None:
            import tiktoken

            self.encoding = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> int:
        if self.encoding is None:
            return len(text.split())
        return len(self.encoding.encode_ordinary(text))


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a tiktoken file; a missing file is an error."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class SourceMix:
    """A mix of documents in which every source has its share of the total size.

    docs: doc, text, source. targets: source, target_permille, max_repeat. Sources are compared trimmed and lower-cased.
    The mix is to be as large as all documents of target sources together; a source is repeated at most max_repeat times.
    Sizes are tokens of the vocabulary file `tokenizer`, which the driver reads once and sends to the tasks, so that all of them
    count alike; a file that is missing is an error. With None, sizes are pieces between white space.

    Low-discrepancy schedule: the mix is a row of slots of `block` tokens. Slot i lies at the golden-ratio point
    frac((i + 1/2) x 0.618...) and belongs to the source whose stretch of the cumulated weights holds the point, so that
    every stretch of the mix, not only the whole, has the shares. The documents of a source, shuffled by hash, are one
    stream cut into blocks; its k-th slot takes block k modulo the number of blocks, in pass k over that number, as
    long as that is below max_repeat. Slots beyond stay empty and are reported, not given to others.

    Ranks of slots and places of documents come from counts of stretches and buckets, so that a source with most of the
    documents is spread over many tasks. Documents with null source or one that has no target are left out before they
    are tokenized; null and blank texts have size 0 and no place. Repeated texts and ids count each time. Repeated
    targets add up permilles and keep the larger repeat; null ones count as 0. Empty tables give no or zero rows.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = TOKENIZER, block: int = 512, seed: str = "mix") -> None:
        wanted = targets.select(F.col("source").alias("name"), source_label(F.col("source")).alias("s"), F.coalesce("target_permille", F.lit(0)).alias("p"), F.coalesce("max_repeat", F.lit(0)).alias("r"))
        rows = wanted.where("s is not null").groupBy("s").agg(F.min("name").alias("name"), F.sum("p").cast("bigint").alias("p"), F.max("r").cast("bigint").alias("r")).orderBy("s").limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} target sources")
        self.spark, self.doc, self.block = docs.sparkSession, doc, block
        self.targets = rows
        table = self.spark.createDataFrame([(i, r.s) for i, r in enumerate(rows)], "src int, s string")
        kind = dict(docs.dtypes)[doc]
        own = docs.select(F.col(doc).alias("d"), F.col(text).alias("t"), source_label(F.col(source)).alias("s")).join(F.broadcast(table), "s").select("d", "t", "src")
        schema = pa.schema([("d", pa.int64() if kind == "bigint" else pa.string()), ("src", pa.int32()), ("size", pa.int64())])
        if kind != "bigint":
            own = own.withColumn("d", F.col("d").cast("string"))

        sent = self.spark.sparkContext.broadcast(None if tokenizer is None else read_ranks(tokenizer))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = TokenCounter(sent.value)
            for b in batches:
                sizes = [count(t) if t and not t.isspace() else 0 for t in column(b, "t")]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array(sizes, pa.int64())], schema=schema)

        self.sizes = own.mapInArrow(measure, f"d {'bigint' if kind == 'bigint' else 'string'}, src int, size bigint").withColumn("h", F.xxhash64(F.lit(seed), F.col("d").cast("string")))
        self._totals: dict[int, int] | None = None

    @property
    def totals(self) -> dict[int, int]:
        """Size of every source, by its number; one pass over the documents."""
        if self._totals is None:
            got = self.sizes.groupBy("src").agg(F.sum("size").alias("n")).collect()
            self._totals = {r.src: r.n or 0 for r in got}
        return self._totals

    def _slots(self) -> DataFrame:
        """slot and src of the whole schedule; slots beyond the weights' sum (if they add up to less than 1000) have none."""
        n = -(-sum(self.totals.values()) // self.block)
        ends, at = [], 0
        for r in self.targets:
            at += r.p
            ends.append(at / max(1000, sum(x.p for x in self.targets)))
        point = (F.col("slot") + 0.5) * GOLDEN
        u = point - F.floor(point)
        found = F.array_position(F.transform(F.array(*map(F.lit, ends)), lambda e: u < e), True) - 1
        return self.spark.range(n).select(F.col("id").alias("slot")).withColumn("src", found.cast("int")).where("src >= 0")

    def report(self) -> DataFrame:
        """One row per target source: source, target_permille, max_repeat, available, target_size, slots (of the schedule),
        filled_slots, reached_size, reached_permille (of the total), passes (times the source is used), short: the schedule
        has more slots of the source than its blocks fill in max_repeat passes. Slots are whole blocks and a schedule of n
        slots is off by up to about log n of them; where a source is so close to filling its slots, the sizes in tokens
        decide (available x max_repeat < target)."""
        total = sum(self.totals.values())
        off = 2 + math.ceil(math.log2(2 + total / self.block))
        slots = {r.src: r.n for r in self._slots().groupBy("src").agg(F.count("*").alias("n")).collect()}
        rows = []
        for i, t in enumerate(self.targets):
            size, k = self.totals.get(i, 0), slots.get(i, 0)
            blocks = -(-size // self.block)
            filled = min(k, blocks * t.r)
            full, rest = divmod(filled, blocks) if blocks else (0, 0)
            reached = full * size + min(rest * self.block, size)
            rows.append((t.name, t.p, t.r, size, t.p * total / 1000, k, filled, reached, 1000 * reached / total if total else 0.0, reached / size if size else 0.0, size * t.r * 1000 < t.p * total if abs(k - blocks * t.r) <= t.r + off else k > blocks * t.r))
        return self.spark.createDataFrame(rows, "source string, target_permille bigint, max_repeat bigint, available bigint, target_size double, slots bigint, filled_slots bigint, reached_size bigint, reached_permille double, passes double, short boolean")

    def mix(self) -> DataFrame:
        """The mix: slot, source, pass, doc, from_token, to_token; a slot's rows are the documents its block consists of."""
        table = [(i, t.name, t.r, -(-self.totals.get(i, 0) // self.block)) for i, t in enumerate(self.targets)]
        info = F.broadcast(self.spark.createDataFrame(table, "src int, source string, most bigint, blocks bigint"))
        slots = self._slots().withColumn("stretch", F.floor(F.col("slot") / STRETCH))
        per = slots.groupBy("src", "stretch").agg(F.count("*").alias("n"))
        before = per.select("src", "stretch", (F.sum("n").over(Window.partitionBy("src").orderBy("stretch")) - F.col("n")).alias("before"))
        rank = F.row_number().over(Window.partitionBy("src", "stretch").orderBy("slot")) - 1 + F.col("before")
        ranked = slots.join(before, ["src", "stretch"]).withColumn("k", rank).join(info, "src").where("blocks > 0")
        taken = ranked.withColumn("pass", F.floor(F.col("k") / F.col("blocks"))).where("pass < most").withColumn("block", F.col("k") % F.col("blocks"))
        sized = self.sizes.where("size > 0").withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
        bucket = sized.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
        offset = bucket.select("src", "bucket", (F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("offset"))
        order = Window.partitionBy("src", "bucket").orderBy("h", "d", "size").rowsBetween(Window.unboundedPreceding, 0)
        placed = sized.join(offset, ["src", "bucket"]).withColumn("end", F.col("offset") + F.sum("size").over(order)).withColumn("begin", F.col("end") - F.col("size"))
        b = F.lit(self.block)
        pieces = placed.select("src", "d", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((F.col("end") - 1) / b))).alias("block"))
        cut = pieces.select("src", "block", "d", F.greatest(F.col("block") * b - F.col("begin"), F.lit(0)).alias("from_token"), (F.least((F.col("block") + 1) * b, F.col("end")) - F.col("begin")).alias("to_token"))
        return taken.join(cut, ["src", "block"]).select("slot", "source", "pass", F.col("d").alias(self.doc), "from_token", "to_token")
