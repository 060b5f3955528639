"""Documents packed one to a row, and passes over them that add up fixed-size sums.

Item parameters number as many as topics and live on the driver; what grows with the data stays in the packed table. A
pass sends the parameters along, every task adds up its own sums, and one row a sum and task comes back to be added.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Topics or terms that a fit takes at most; its parameters are kept on the driver.
MOST_ITEMS = 100_000
#: Numbers in one piece of a sum, and tasks whose sums come to the driver as they are.
CHUNK, DIRECT = 1_000_000, 64
#: Numbers in a table of documents by items that a task makes at a time; batches are cut so that none is larger.
DENSE = 8_000_000


@dataclass
class Batch:
    """Cells of some documents: `doc` and `item` index the cells, `theta` and `weight` the documents."""

    doc: np.ndarray
    item: np.ndarray
    y: np.ndarray
    s: np.ndarray
    weight: np.ndarray
    theta: np.ndarray
    documents: int

    def by_doc(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=x, minlength=self.documents)

    def by_item(self, x: np.ndarray, items: int) -> np.ndarray:
        return np.bincount(self.item, weights=x, minlength=items)


def _read(b: pa.RecordBatch) -> Batch:
    def flat(i: int, kind) -> np.ndarray:
        return b.column(i).flatten().to_numpy(zero_copy_only=False).astype(kind)

    lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
    n = b.num_rows
    return Batch(np.repeat(np.arange(n), lengths), flat(1, np.int64), flat(2, np.float64), flat(3, np.float64), b.column(4).to_numpy(zero_copy_only=False).astype(np.float64), b.column(5).to_numpy(zero_copy_only=False).astype(np.float64), n)


class Packed:
    """Cells (doc, topic, y > 0, s) packed by document, with a weight and a position for each.

    Null documents and topics and empty cells are left out; repeated cells are added up.
    """

    def __init__(self, table: DataFrame, items: list) -> None:
        self.table, self.items = table, items
        self._tasks: int | None = None

    @classmethod
    def of(cls, cells: DataFrame, doc: str = "doc_id", topic: str = "topic", weight: DataFrame | None = None) -> Packed:
        c = cells.select(F.col(doc).alias("doc"), F.col(topic).alias("topic"), F.col("y").cast("double").alias("y"), F.col("s").cast("double").alias("s")).where("doc is not null and topic is not null and y > 0")
        names = [r.topic for r in c.select("topic").distinct().orderBy("topic").limit(MOST_ITEMS + 1).collect()]
        if len(names) > MOST_ITEMS:
            raise ValueError(f"more than {MOST_ITEMS} items")
        spark = cells.sparkSession
        index = spark.createDataFrame([(t, i) for i, t in enumerate(names)], f"topic {dict(c.dtypes)['topic']}, item bigint")
        g = c.join(F.broadcast(index), "topic").groupBy("doc", "item").agg(F.sum("y").alias("y"), F.sum("s").alias("s")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("item", "y", "s"))).alias("c"))
        w = F.lit(1.0)
        if weight is not None:
            g = g.join(weight.select(F.col(doc).alias("doc"), F.col("weight").cast("double").alias("weight")), "doc", "left")
            w = F.coalesce("weight", F.lit(1.0))
        return cls(cut(g.select("doc", F.col("c.item").alias("item"), F.col("c.y").alias("y"), F.col("c.s").alias("s"), w.alias("weight"), F.lit(0.0).alias("theta"))), names)

    def sums(self, f: Callable[[Batch], np.ndarray], dense: bool = True) -> np.ndarray:
        """The sum over all batches of f's vector, whose length does not depend on the data. Batches are small enough for a
        table of documents by items, unless f makes none (`dense`).

        Every task hands on its sum in binary pieces of CHUNK numbers. Where tasks are many or vectors long, pieces of one
        place are brought together and added before they come to the driver, which then gets about one vector.
        """
        schema = pa.schema([("k", pa.int32()), ("v", pa.binary())])

        step = max(1, DENSE // max(1, len(self.items) if dense else 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for i in range(0, b.num_rows, step):
                    x = f(_read(b.slice(i, step)))
                    total = x if total is None else total + x
            if total is not None:
                for k in range(0, len(total), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([np.ascontiguousarray(total[k : k + CHUNK], dtype=np.float64).tobytes()])], schema=schema)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    x = np.frombuffer(v)
                    held[k] = held[k] + x if k in held else x
            for k, x in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()])], schema=schema)

        parts = self.table.mapInArrow(run, "k int, v binary")
        tasks = self.tasks
        if tasks > DIRECT:
            parts = parts.repartition(max(1, math.isqrt(tasks))).mapInArrow(add, "k int, v binary")
        held: dict[int, np.ndarray] = {}
        for r in parts.collect():
            x = np.frombuffer(r.v)
            held[r.k] = held[r.k] + x if r.k in held else x
        return np.concatenate([held[k] for k in sorted(held)]) if held else np.zeros(0)

    @property
    def tasks(self) -> int:
        """Partitions of the packed table; a checkpointed table knows them without a job."""
        if self._tasks is None:
            self._tasks = self.table.rdd.getNumPartitions()
        return self._tasks

    def moved(self, f: Callable[[Batch], np.ndarray], keep: bool = True, dense: bool = True) -> Packed:
        """The same documents with new positions; cut from what made them. For `dense` see sums."""
        schema, step = self.table.schema, max(1, DENSE // max(1, len(self.items) if dense else 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, step):
                    own = b.slice(i, step)
                    yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(5)), pa.array(f(_read(own)))], names=schema.names)

        out = self.table.mapInArrow(run, schema)
        moved = Packed(cut(out) if keep else out, self.items)
        moved._tasks = self._tasks
        return moved
