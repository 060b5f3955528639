"""Queries about joins, keys, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as ops
from ..sources.tables import table
from . import query
from .base import US, md5_mod, md5_mod_sql, us_chunks


@query("""WITH k AS (SELECT n_name || '|' || n_regionkey || '|' || n_nationkey AS key FROM nation)
SELECT key, string_split(key, '|')[1] AS p0, string_split(key, '|')[3] AS p2, string_split(key, '|')[9] AS p8 FROM k""")
def composite_key_split(spark, d):
    k = table(spark, d, "nation").select(ops.composite_key("n_name", "n_regionkey", "n_nationkey").alias("key"))
    return k.select("key", *(ops.key_part("key", i).alias(f"p{i}") for i in (0, 2, 8)))


@query("SELECT DISTINCT chunk_id FROM br_manifestos_chunks_sent WHERE doc_id IN (SELECT platform_id FROM platform_party_map WHERE valid_mayor_platform)")
def valid_office_semi(spark, d):
    valid = table(spark, d, "platform_party_map").where("valid_mayor_platform").select(F.col("platform_id").alias("doc_id"))
    return table(spark, d, "br_manifestos_chunks_sent").select("chunk_id", "doc_id").join(valid, "doc_id", "left_semi").select("chunk_id").distinct()


_LISTED = "(SELECT platform_id AS doc_id FROM platform_party_map WHERE valid_mayor_platform = false)"


@query(f"""WITH c AS (SELECT doc_id, count(DISTINCT chunk_id) AS n FROM br_manifestos_chunks_sent GROUP BY 1), l AS (SELECT DISTINCT doc_id FROM {_LISTED})
SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS kept, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS excluded, count(*) FILTER (WHERE l.doc_id IS NOT NULL AND n >= 10) AS floor_would_keep FROM c LEFT JOIN l USING (doc_id)""")
def confirmed_exclusion_anti(spark, d):
    listed = table(spark, d, "platform_party_map").where("valid_mayor_platform = false").select(F.col("platform_id").alias("doc_id")).distinct()
    c = table(spark, d, "br_manifestos_chunks_sent").groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("n"))
    j = c.join(listed.withColumn("hit", F.lit(True)), "doc_id", "left")
    hit = F.col("hit").isNotNull()
    return j.agg(F.count_if(~hit).alias("kept"), F.count_if(hit).alias("excluded"), F.count_if(hit & (F.col("n") >= 10)).alias("floor_would_keep"))


@query("""WITH b AS (SELECT doc_id, min(kind) AS kind FROM kind_labels WHERE kind IS NOT NULL GROUP BY 1)
SELECT d.doc_id, d.source, b.kind FROM documents d LEFT JOIN b USING (doc_id)""")
def benchmark_left_join(spark, d):
    b = ops.dedup(table(spark, d, "kind_labels").where("kind is not null").select("doc_id", "kind"), ["doc_id"], ["kind"], "first")
    return table(spark, d, "documents").select("doc_id", "source").join(b, "doc_id", "left")


@query("""WITH m AS (SELECT platform_id AS doc_id, min(upper(trim(party))) AS party FROM platform_party_map WHERE party IS NOT NULL GROUP BY 1)
SELECT coalesce(party, 'UNKNOWN') AS party, count(DISTINCT chunk_id) AS chunks FROM br_manifestos_chunks_sent LEFT JOIN m USING (doc_id) GROUP BY 1""")
def party_unknown_fill(spark, d):
    m = table(spark, d, "platform_party_map").where("party is not null").groupBy(F.col("platform_id").alias("doc_id")).agg(F.min(F.upper(F.trim("party"))).alias("party"))
    c = table(spark, d, "br_manifestos_chunks_sent").select("doc_id", "chunk_id").distinct()
    return c.join(m, "doc_id", "left").groupBy(F.coalesce("party", F.lit("UNKNOWN")).alias("party")).agg(F.count("*").alias("chunks"))


@query("""SELECT batch_id, id, chunk_id, political, score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, received_at DESC, batch_id DESC, id DESC, political DESC NULLS LAST, score DESC NULLS LAST) AS k FROM score_records) WHERE k = 1""")
def dedup_keep_last(spark, d):
    s = table(spark, d, "score_records").select("chunk_id", "created_at", "received_at", "batch_id", "id", "political", "score")
    return ops.dedup(s, ["chunk_id"], ["created_at", "received_at"]).select("batch_id", "id", "chunk_id", "political", "score")


@query("""WITH new AS (SELECT o_custkey, max(o_totalprice) AS price, 'new' AS origin FROM orders WHERE o_custkey % 7 = 0 GROUP BY 1), old AS (SELECT o_custkey, min(o_totalprice) AS price, 'old' AS origin FROM orders GROUP BY 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM new)""")
def upsert_keyed(spark, d):
    o = table(spark, d, "orders")
    new = o.where("o_custkey % 7 = 0").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price")).withColumn("origin", F.lit("new"))
    old = o.groupBy("o_custkey").agg(F.min("o_totalprice").alias("price")).withColumn("origin", F.lit("old"))
    return ops.upsert(old, new, ["o_custkey"])


@query("""WITH a AS (SELECT DISTINCT platform_id AS doc_id FROM platform_party_map), b AS (SELECT DISTINCT doc_id FROM br_manifestos_chunks_sent)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'extra' WHEN b.doc_id IS NULL THEN 'missing' ELSE 'both' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def reconcile_lists(spark, d):
    return ops.reconcile(table(spark, d, "platform_party_map").select(F.col("platform_id").alias("doc_id")), table(spark, d, "br_manifestos_chunks_sent"), "doc_id")


@query("""SELECT 'unique' AS rule, platform_id AS value, count(*) AS n FROM platform_party_map GROUP BY platform_id HAVING count(*) > 1
UNION ALL SELECT 'domain round', coalesce(CAST(round AS VARCHAR), ''), count(*) FROM platform_party_map WHERE round NOT IN (1) OR round IS NULL GROUP BY round
UNION ALL SELECT 'covered', platform_id, count(*) FROM platform_party_map WHERE platform_id NOT IN (SELECT doc_id FROM br_manifestos_chunks_sent) GROUP BY platform_id""")
def validate_map(spark, d):
    m = table(spark, d, "platform_party_map")
    return ops.violations(m, ["platform_id"], {"round": ["1"]}, table(spark, d, "br_manifestos_chunks_sent").select(F.col("doc_id").alias("platform_id")))


@query("SELECT event_type, count(*) FILTER (WHERE h < 6) AS night, count(*) FILTER (WHERE h >= 6 AND h < 12) AS morning, count(*) FILTER (WHERE h >= 12) AS later FROM (SELECT event_type, hour(ts) AS h FROM events) GROUP BY event_type")
def pivot_wide(spark, d):
    h = F.hour("ts")
    part = F.when(h < 6, "night").when(h < 12, "morning").otherwise("later")
    return table(spark, d, "events").select("event_type", part.alias("part")).groupBy("event_type").pivot("part", ["night", "morning", "later"]).count().na.fill(0)


@query("SELECT p_partkey, 'size' AS measure, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot_long(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "measure", "value")


@query("""WITH g AS (SELECT batch_id, epoch(created_at) - epoch(lag(created_at) OVER (PARTITION BY batch_id ORDER BY created_at, id)) AS gap FROM (SELECT DISTINCT * FROM score_records))
SELECT batch_id, CAST(sum(CASE WHEN gap > 60 THEN gap ELSE 0 END) AS DOUBLE) AS idle_seconds, count(*) FILTER (WHERE gap > 60) AS pauses FROM g GROUP BY batch_id""")
def idle_gap_seconds(spark, d):
    s = table(spark, d, "score_records").distinct().withColumn("t", F.col("created_at").cast("timestamp").cast("double"))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("batch_id").orderBy("t", "id"))
    g = s.withColumn("gap", gap)
    idle = F.col("gap") > 60
    return g.groupBy("batch_id").agg(F.sum(F.when(idle, F.col("gap")).otherwise(0.0)).alias("idle_seconds"), F.count_if(idle).alias("pauses"))


@query("""WITH c AS (SELECT DISTINCT doc_id, chunk_id, chunk_text, CAST(regexp_extract(chunk_id, '#s([0-9]+)$', 1) AS BIGINT) AS n FROM br_manifestos_chunks_sent WHERE chunk_text IS NOT NULL),
f AS (SELECT *, regexp_matches(chunk_text, '[.!?;:…]["'')”’\\]]?$') AS ends FROM c),
w AS (SELECT chunk_id, ends, coalesce(lag(ends) OVER (PARTITION BY doc_id ORDER BY n), true) AS prev FROM f)
SELECT chunk_id, ends, prev AND ends AS full_sentence FROM w""")
def sentence_completeness(spark, d):
    """A chunk is a full sentence if it ends one and the chunk before it did."""
    c = table(spark, d, "br_manifestos_chunks_sent").where("chunk_text is not null").select("doc_id", "chunk_id", "chunk_text").distinct()
    f = c.withColumn("n", F.regexp_extract("chunk_id", "#s([0-9]+)$", 1).cast("bigint")).withColumn("ends", F.col("chunk_text").rlike(r"""[.!?;:…]["')”’\]]?$"""))
    prev = F.lag("ends", 1, True).over(Window.partitionBy("doc_id").orderBy("n"))
    return f.withColumn("prev", prev).select("chunk_id", "ends", (F.col("prev") & F.col("ends")).alias("full_sentence"))


@query(f"""WITH {US}, g AS (SELECT doc_id, party_label, chunk_id, {md5_mod_sql("chunk_id || 'a'", 3)} AS a, {md5_mod_sql("chunk_id || 'b'", 3)} AS b, {md5_mod_sql("chunk_id || 'c'", 3)} AS c FROM us),
v AS (SELECT chunk_id, unnest([a, b, c]) AS v FROM g), n AS (SELECT chunk_id, v, count(*) AS k FROM v GROUP BY ALL)
SELECT chunk_id, CAST(v AS INTEGER) AS modal, round(k / 3, 6) AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY k DESC, v) AS r FROM n) WHERE r = 1""")
def mode_agreement_replicates(spark, d):
    """The commonest of three replicate codes of a chunk, the lowest of equals, and how many agree."""
    v = us_chunks(spark, d).select("chunk_id", F.explode(F.array(*(md5_mod(F.concat("chunk_id", F.lit(x)), 3) for x in "abc"))).alias("v"))
    n = v.groupBy("chunk_id", "v").agg(F.count("*").alias("k"))
    best = n.groupBy("chunk_id").agg(F.max(F.struct("k", F.negative("v").alias("m"))).alias("s"))
    return best.select("chunk_id", F.negative(F.col("s.m")).cast("int").alias("modal"), F.round(F.col("s.k") / F.lit(3.0), 6).alias("agreement"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY n_name""")
def star_join_revenue(spark, d):
    t = lambda n: table(spark, d, n)
    near = t("nation").join(F.broadcast(t("region").where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"))
    o = t("orders").where("o_orderdate >= timestamp_ntz'1994-01-01' and o_orderdate < timestamp_ntz'1996-01-01'")
    j = t("customer").join(F.broadcast(near), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
