"""Queries that run a stream over a table to its end."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import scratch
from ..streaming import incremental as ops
from . import query


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if os.path.isdir(path) else f"{name}.parquet").parquet(path if os.path.isdir(path) else d)


def _run(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the stream gives, written to and read from the shared folder."""
    at = scratch(spark)
    schema = df.schema

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out").select(*schema.names)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    """Hourly counts; complete mode, so that the last windows come out as well."""
    e = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _run(spark, ops.windowed_counts(e, "ts", "event_type", late="365 days"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT DISTINCT user_id, ts FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL), g AS (SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800, true) AS opens FROM e),
s AS (SELECT user_id, ts, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS part FROM g), x AS (SELECT user_id, part, min(ts) AS start, max(ts) AS last FROM s GROUP BY ALL)
SELECT x.user_id, x.start, x.last + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM x JOIN events v ON v.user_id = x.user_id AND v.ts BETWEEN x.start AND x.last GROUP BY ALL""")
def stream_session_gaps(spark, d):
    """Sessions of users in the event stream: those the watermark has closed, and those that are open when it ends."""
    e = _stream(spark, d, "events").where("ts is not null and user_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _run(spark, ops.sessions(e, "ts", "user_id", "30 minutes", "1 hour"), "complete")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n")


@query("SELECT DISTINCT batch_id, id, chunk_id FROM score_records WHERE created_at IS NOT NULL")
def stream_score_log(spark, d):
    """The score log with every record once."""
    s = _stream(spark, d, "score_records").where("created_at is not null").withColumn("created_at", F.col("created_at").cast("timestamp")).select("batch_id", "id", "chunk_id", "created_at")
    return _run(spark, ops.deduplicated_log(s, ["batch_id", "id", "chunk_id"], "created_at", "3650 days")).select("batch_id", "id", "chunk_id")


@query()
def stream_chunk_counts(spark, d):
    """Documents chunked as they arrive."""
    at = scratch(spark)
    ops.chunk_stream(_stream(spark, d, "documents"), f"{at}/chunks", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("word_count").alias("words"))
