"""Queries about samples, splits, allocation and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as ops
from ..sources.tables import table
from . import query


def _pool(spark, d):
    trimmed = lambda c: F.lower(F.trim(c))
    return table(spark, d, "stratified_stance_sample").where("dimension is not null and stance is not null and sid is not null").select("sid", "manifesto_id", "language", trimmed("dimension").alias("dimension"), trimmed("stance").alias("stance")).distinct()


_POOL = "pool AS (SELECT DISTINCT sid, manifesto_id, language, lower(trim(dimension)) AS dimension, lower(trim(stance)) AS stance FROM stratified_stance_sample WHERE dimension IS NOT NULL AND stance IS NOT NULL AND sid IS NOT NULL)"


@query(f"WITH {_POOL} SELECT sid, dimension, stance FROM (SELECT *, row_number() OVER (PARTITION BY dimension, stance ORDER BY md5('draw:' || sid), sid) AS k FROM pool) WHERE k <= 10")
def stratified_sample(spark, d):
    return ops.per_stratum(_pool(spark, d), ["dimension", "stance"], "sid", 10, "draw").select("sid", "dimension", "stance")


@query(f"WITH {_POOL} SELECT sid FROM pool ORDER BY md5('all:' || sid), sid LIMIT 100")
def uniform_sample(spark, d):
    return ops.uniform(_pool(spark, d), "sid", 100, "all").select("sid")


@query(f"""WITH {_POOL}, n AS (SELECT stance, count(*) AS n FROM pool GROUP BY 1), r AS (SELECT p.*, n, row_number() OVER (PARTITION BY stance ORDER BY sid) - 1 AS r FROM pool p JOIN n USING (stance))
SELECT sid, stance, CAST(unnest(range(0, ((SELECT max(n) FROM n) - 1 - r) // n + 1)) AS INTEGER) AS copy FROM r""")
def oversample_to_max(spark, d):
    return ops.oversample(_pool(spark, d), "stance", "sid").select("sid", "stance", "copy")


_NIBBLE = "CASE WHEN ascii(substr(h, {0}, 1)) >= 97 THEN ascii(substr(h, {0}, 1)) - 87 ELSE ascii(substr(h, {0}, 1)) - 48 END"


@query(f"""WITH {_POOL}, h AS (SELECT *, md5('split:' || manifesto_id) AS h FROM pool), b AS (SELECT *, ({_NIBBLE.format(1)}) * 16 + ({_NIBBLE.format(2)}) AS b FROM h)
SELECT sid, manifesto_id, CASE WHEN b * 100 < 256 * 70 THEN 'train' WHEN b * 100 < 256 * 85 THEN 'validation' ELSE 'test' END AS split FROM b WHERE manifesto_id IS NOT NULL""")
def group_split(spark, d):
    return ops.group_split(_pool(spark, d).where("manifesto_id is not null"), "manifesto_id").select("sid", "manifesto_id", "split")


@query(f"""WITH {_POOL}, n AS (SELECT language AS party, count(*) AS n FROM pool WHERE language IS NOT NULL GROUP BY 1),
s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n, party ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER () - row_number() OVER (ORDER BY n, party) + 1 AS left_ FROM n),
a AS (SELECT *, n <= (300 - before) // left_ AS fits FROM s), g AS (SELECT coalesce(sum(n) FILTER (WHERE fits), 0) AS given, count(*) FILTER (WHERE NOT fits) AS open FROM a)
SELECT party, n, CAST(CASE WHEN fits THEN n ELSE (300 - given) // greatest(open, 1) + CAST(row_number() OVER (PARTITION BY fits ORDER BY party) <= (300 - given) % greatest(open, 1) AS INT) END AS BIGINT) AS seats FROM a, g""")
def capped_allocation(spark, d):
    n = _pool(spark, d).where("language is not null").groupBy(F.col("language").alias("party")).agg(F.count("*").alias("n"))
    return ops.capped_allocation(n, 300)


_BATCHES = f"""WITH {_POOL}, k AS (SELECT DISTINCT sid FROM pool), b AS (SELECT sid, (row_number() OVER (ORDER BY sid) - 1) // 50 AS batch FROM k)"""


@query(_BATCHES + " SELECT printf('r%03d', batch) AS batch_id, count(*) AS n, sha256(string_agg(sid, '|' ORDER BY sid)) AS chunk_sha256 FROM b GROUP BY batch")
def batch_manifest(spark, d):
    """Batches of fifty keys with the hash that a resumed run compares."""
    b = ops.batches(_pool(spark, d).select("sid").distinct(), "sid", 50)
    g = b.groupBy("batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("sid")).alias("ids"))
    return g.select(F.format_string("r%03d", "batch").alias("batch_id"), "n", F.sha2(F.array_join("ids", "|"), 256).alias("chunk_sha256"))
