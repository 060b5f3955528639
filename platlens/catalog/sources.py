"""Round trips through sources and sinks: what is read back must be what the table holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational
from ..plans.lineage import scratch
from ..sources import io
from ..sources.tables import table
from . import query
from .base import CELLS
from .cells import cells_of


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, n_chars FROM documents WHERE regexp_matches(text, '[^\\s\\p{Z}]')")
def csv_roundtrip(spark, d):
    """Texts with quotes and line breaks through a CSV under an explicit schema, blank ones left out, some columns read."""
    at = scratch(spark)
    io.write_csv(table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars"), f"{at}/csv")
    return io.read_csv(spark, f"{at}/csv", "doc_id string, text string, lang string, n_chars bigint", ["doc_id", "lang", "n_chars"], "text")


@query("SELECT DISTINCT batch_id, chunk_id, score FROM score_records")
def log_roundtrip(spark, d):
    """Records appended to a log twice, with a broken line and another version in between, come back once."""
    at = f"{scratch(spark)}/log"
    s = table(spark, d, "score_records").select("batch_id", "chunk_id", "score").distinct()
    rows = s.select(F.lit(1).alias("schema_version"), "*", F.sha2(F.to_json(F.struct("batch_id", "chunk_id", "score")), 256).alias("key"))
    io.append_jsonl(rows, at, "key")
    spark.createDataFrame([('{"schema_version": 1, "batch_id": "tru',), ('{"schema_version": 2, "batch_id": "old", "chunk_id": "c", "score": 1, "key": "k"}',)], "value string").write.mode("append").text(at)
    io.append_jsonl(rows, at, "key")
    return io.read_jsonl(spark, at, "schema_version int, batch_id string, chunk_id string, score int, key string", 1).select("batch_id", "chunk_id", "score")


@query("SELECT o_custkey, CAST(sum(o_totalprice) AS DOUBLE) > 0 AS positive, count(*) AS n FROM orders GROUP BY 1")
def cached_roundtrip(spark, d):
    """A table built once under the key of its set of values, and found again."""
    o = table(spark, d, "orders")
    at = f"{scratch(spark)}/{io.content_key(o, 'o_custkey')}"
    build = lambda: o.groupBy("o_custkey").agg((F.sum("o_totalprice") > 0).alias("positive"), F.count("*").alias("n"))
    io.cached(spark, at, build)
    return io.cached(spark, at, lambda: spark.createDataFrame([], "never string"))


@query("SELECT o_orderpriority, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE n END AS n FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)")
def upsert_roundtrip(spark, d):
    """A stored table with the rows of one key replaced."""
    at = f"{scratch(spark)}/table"
    n = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    io.upsert_table(n, at, ["o_orderstatus"])
    io.upsert_table(n.where("o_orderstatus = 'F'").withColumn("n", F.lit(-1).cast("bigint")), at, ["o_orderstatus"])
    return spark.read.parquet(at)


@query(CELLS + " SELECT doc_id, topic, y, s, 'us' AS corpus FROM cells")
def bundle_roundtrip(spark, d):
    """Cells and topics of a corpus as a bundle with a row of what it is."""
    at = f"{scratch(spark)}/bundle"
    cells = cells_of(spark, d)
    io.write_bundle(at, {"cells": cells, "topics": cells.select("topic").distinct()}, corpus="us")
    tables, meta = io.read_bundle(spark, at)
    kept = tables["cells"].join(tables["topics"], "topic", "left_semi")
    return kept.select("doc_id", "topic", "y", "s", F.lit(meta["corpus"]).alias("corpus"))


@query("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings")
def matrix_roundtrip(spark, d):
    """Vectors as cells without zeros, and back."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return io.rows_to_vectors(io.vectors_to_rows(e, "vec_id", "v"), "vec_id", 64)


@query("SELECT CAST(event_type AS VARCHAR) AS stage, 'all' AS corpus, count(*) AS runs, round(sum(value), 3) AS seconds, count(*) AS n_docs FROM events GROUP BY 1")
def times_roundtrip(spark, d):
    """A register of run times, appended to by stage, and its totals."""
    at = f"{scratch(spark)}/times"
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).orderBy("event_type").limit(100).collect()
    for r in e:
        for _ in range(2):
            io.register_time(spark, at, r.event_type, "all", "half", r.v / 2, n_docs=r.n)
    t = io.read_times(spark, at)
    return t.select("stage", "corpus", (F.col("runs") / 2 * F.col("n_docs")).cast("bigint").alias("runs"), "seconds", "n_docs")


@query("SELECT DISTINCT lower(trim(dimension)) AS dimension, lower(trim(stance)) AS stance, target_permille FROM stance_targets")
def small_table_loaded(spark, d):
    """A small table under untidy column names, brought to the names it must have."""
    t = table(spark, d, "stance_targets").select(F.concat(F.lit(" "), "dimension").alias(" dimension"), F.col("stance").alias("stance "), "target_permille")
    named = io.with_required(t, ["dimension", "stance", "target_permille"])
    return relational.dedup(named.select(F.lower("dimension").alias("dimension"), F.lower("stance").alias("stance"), "target_permille"), ["dimension", "stance", "target_permille"], ["target_permille"])


@query("SELECT chunk_id, trim(regexp_replace(regexp_replace(regexp_replace(chunk_text, '(\\p{Ll})([.!?])(\\p{Lu})', '\\1\\2 \\3', 'g'), '[-–_=.]{4,}', ' ', 'g'), '\\s+', ' ', 'g')) AS chunk_text FROM (SELECT DISTINCT chunk_id, chunk_text FROM br_manifestos_chunks_sent WHERE chunk_text IS NOT NULL)")
def stops_spaced(spark, d):
    """Spaces behind stops between small and capital letters, rules of dashes blanked, white space squeezed."""
    t = F.regexp_replace("chunk_text", r"(?<=\p{Ll})([.!?])(?=\p{Lu})", "$1 ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[-–_=.]{4,}", " "), r"\s+", " "))
    return table(spark, d, "br_manifestos_chunks_sent").where("chunk_text is not null").select("chunk_id", "chunk_text").distinct().select("chunk_id", t.alias("chunk_text"))


_BOUND = ["dr", "dra", "sr", "sra", "prof", "exmo", "art", "av", "r"]


@query(f"SELECT chunk_id, CAST(len(w) AS BIGINT) AS stops, CAST(len(list_filter(w, lambda x: lower(x) IN ({', '.join(repr(x) for x in _BOUND)}))) AS BIGINT) AS vetoed FROM (SELECT chunk_id, regexp_extract_all(chunk_text, '(\\p{{L}}+)\\.[\"”’)]?\\s', 1) AS w FROM (SELECT DISTINCT chunk_id, chunk_text FROM br_manifestos_chunks_sent WHERE chunk_text IS NOT NULL))")
def abbreviation_vetoes(spark, d):
    """Full stops with white space behind them, and those that an abbreviation before them refuses."""
    c = table(spark, d, "br_manifestos_chunks_sent").where("chunk_text is not null").select("chunk_id", "chunk_text").distinct()
    w = F.regexp_extract_all("chunk_text", F.lit(r"(\p{L}+)\.[\"”’)]?\s"), F.lit(1))
    return c.select("chunk_id", F.size(w).cast("bigint").alias("stops"), F.size(F.filter(w, lambda x: F.lower(x).isin(_BOUND))).cast("bigint").alias("vetoed"))
