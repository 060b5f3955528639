"""Inputs that several registered queries share, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def md5_mod(key: Column, n: int) -> Column:
    """A bucket that both engines compute alike."""
    h = F.md5(key)
    return sum((F.ascii(F.substring(h, i, 1)) * w for i, w in ((1, 1), (2, 31), (3, 961))), F.lit(0)) % n


def md5_mod_sql(key: str, n: int) -> str:
    return f"((ascii(substr(md5({key}), 1, 1)) + 31 * ascii(substr(md5({key}), 2, 1)) + 961 * ascii(substr(md5({key}), 3, 1))) % {n})"


def us_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the US table once each, with the topic and a stance of -1, 0 or 1."""
    c = table(spark, d, "campaignview_chunks_sent").select("chunk_id", "doc_id", "party_label", "chunk_text", "word_count").distinct()
    t = table(spark, d, "chunk_topics").select("chunk_id", "topic").distinct()
    return c.join(t, "chunk_id").withColumn("stance", (md5_mod(F.col("chunk_id"), 3) - 1).cast("bigint"))


US = f"""
us AS (SELECT c.chunk_id, doc_id, party_label, chunk_text, word_count, topic, CAST({md5_mod_sql('c.chunk_id', 3)} - 1 AS BIGINT) AS stance
  FROM (SELECT DISTINCT chunk_id, doc_id, party_label, chunk_text, word_count FROM campaignview_chunks_sent) c
  JOIN (SELECT DISTINCT chunk_id, topic FROM chunk_topics) t ON t.chunk_id = c.chunk_id)"""

#: Rerouted short chunks, documents of at least five chunks, cells.
CELLS = f"""WITH {US},
ok AS (SELECT * FROM (SELECT chunk_id, doc_id, party_label, stance, CASE WHEN word_count <= 6 THEN -2 ELSE topic END AS topic FROM us) WHERE topic >= 0 OR topic = -2),
big AS (SELECT * FROM ok WHERE doc_id IN (SELECT doc_id FROM ok GROUP BY doc_id HAVING count(*) >= 5)),
cells AS (SELECT doc_id, topic, count(*) AS y, CAST(sum(stance) AS BIGINT) AS s FROM big GROUP BY ALL)"""
