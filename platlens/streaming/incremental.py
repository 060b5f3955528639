"""Streaming forms of the append-shaped steps: chunking of arriving documents, a deduplicated score log, pauses of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.segment import chunk_documents


def chunk_stream(docs: DataFrame, sink: str, checkpoint: str, doc: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Chunks of every arriving batch of documents appended to a parquet folder; batches are written under their number,
    so a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        chunk_documents(batch, doc, text).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated_log(log: DataFrame, key: list[str], at: str, late: str = "30 days") -> DataFrame:
    """The first record of each key; what comes later than the watermark is dropped with its state."""
    return log.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, at: str, kind: str, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Events and sums by tumbling window and kind."""
    g = events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), kind)
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: its events until none comes for `gap`; what lies between sessions is idle time."""
    g = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key)
    return g.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
