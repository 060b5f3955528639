"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..plans.lineage import numbered
from ..sources.tables import table
from . import query

_SIDES = {"left": -1, "neutral": 0, "right": 1}


@query("SELECT DISTINCT sid, CASE lower(trim(stance)) WHEN 'left' THEN -1 WHEN 'neutral' THEN 0 WHEN 'right' THEN 1 END AS side FROM stratified_stance_sample")
def recode_stance(spark, d):
    return table(spark, d, "stratified_stance_sample").select("sid", fn.recode(F.col("stance"), _SIDES).alias("side")).distinct()


@query("SELECT has_pdf, count(*) AS n, count(*) FILTER (WHERE lower(trim(round)) IN ('true', '1', 'yes', 'y', 'x')) AS first_round FROM (SELECT CAST(has_pdf AS VARCHAR) IN ('true') AS has_pdf, ' ' || CAST(round AS VARCHAR) AS round FROM platform_party_map) GROUP BY 1")
def truthy_flags(spark, d):
    m = table(spark, d, "platform_party_map").select(F.when(F.col("has_pdf").isNotNull(), fn.truthy(F.col("has_pdf").cast("string"))).alias("has_pdf"), fn.truthy(F.concat(F.lit(" "), F.col("round").cast("string"))).alias("first"))
    return m.groupBy("has_pdf").agg(F.count("*").alias("n"), F.count_if("first").alias("first_round"))


@query("SELECT regexp_replace(trim(code), '\\.0$', '') AS code, count(*) AS n FROM (SELECT policy_code || CASE WHEN length(chunk_id) % 2 = 0 THEN '.0 ' ELSE '' END AS code FROM campaignview_chunks_sent WHERE policy_code IS NOT NULL) GROUP BY 1")
def plain_codes(spark, d):
    c = table(spark, d, "campaignview_chunks_sent").where("policy_code is not null")
    code = F.concat("policy_code", F.when(F.length("chunk_id") % 2 == 0, ".0 ").otherwise(""))
    return c.select(fn.plain_code(code).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT token, strip_accents(token) AS folded, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(chunk_text), '[a-zà-öø-ÿ]+')) AS token FROM br_manifestos_chunks_sent) WHERE token <> strip_accents(token) GROUP BY ALL")
def accents_stripped(spark, d):
    w = table(spark, d, "br_manifestos_chunks_sent").select(F.explode(F.regexp_extract_all(F.lower("chunk_text"), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))).alias("token"))
    return w.withColumn("folded", fn.strip_accents(F.col("token"))).where("token <> folded").groupBy("token", "folded").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN length(token) <= 3 AND token NOT IN ('SUS', 'IA', 'ONG') THEN 'SHORT' ELSE token END AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(chunk_text, '[A-Za-z]+')) AS token FROM br_manifestos_chunks_sent) GROUP BY 1")
def short_tokens(spark, d):
    w = table(spark, d, "br_manifestos_chunks_sent").select(F.explode(F.regexp_extract_all("chunk_text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token"))
    return w.groupBy(fn.short_token(F.col("token"), ["SUS", "IA", "ONG"]).alias("token")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, regexp_replace(p_brand || ' & 100% of ' || p_type || '_x', '([&%$#_{}])', '\\\\\\1', 'g') AS tex, CAST(CAST(floor(p_retailprice * 10) AS BIGINT) // 3600 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(p_retailprice * 10) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(p_retailprice * 10) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS time FROM part")
def report_formats(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", fn.tex(F.concat("p_brand", F.lit(" & 100% of "), "p_type", F.lit("_x"))).alias("tex"), fn.hms(F.col("p_retailprice") * 10).alias("time"))


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN e IS NULL THEN NULL WHEN e LIKE '%timed out%' OR e LIKE '%timeout%' THEN 'timeout' WHEN e LIKE '%rate limit%' OR e LIKE '%429%' THEN 'rate' WHEN e LIKE '%json%' OR e LIKE '%parse%' THEN 'parse' WHEN e LIKE '%length%' OR e LIKE '%token%' THEN 'length' WHEN e LIKE '%refus%' OR e LIKE '%policy%' THEN 'refused' ELSE 'other' END AS class
FROM (SELECT CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'read timed out' WHEN 2 THEN 'http 429' WHEN 3 THEN 'bad json' WHEN 4 THEN 'max token length' WHEN 5 THEN 'refused by policy' ELSE event_type END AS e FROM events)) GROUP BY 1""")
def failure_classes(spark, d):
    messages = [None, "Read timed out", "HTTP 429", "bad JSON", "max token length", "Refused by policy"]
    e = F.get(F.array(*map(F.lit, messages)), (F.col("event_id") % 7).cast("int"))
    e = F.when(F.col("event_id") % 7 == 6, F.col("event_type")).otherwise(e)
    return table(spark, d, "events").select(fn.failure_class(e).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, array_to_string(string_split_regex(words, ',\\s*')[:3], ', ') AS keywords FROM (SELECT p_partkey, replace(p_type, ' ', ', ') AS words FROM part)")
def keyword_lists(spark, d):
    words = fn.keyword_list(F.replace(F.col("p_type"), F.lit(" "), F.lit(", ")), 3)
    return table(spark, d, "part").select("p_partkey", F.array_join(words, ", ").alias("keywords"))


@query("""SELECT vec_id, round(sqrt(x * x + y * y), 5) AS length, round(CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END, 5) AS angle, round(1 + q + q ** 2 / 4 + q ** 3 / 36 + q ** 4 / 576 + q ** 5 / 14400 + q ** 6 / 518400, 6) AS bessel
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, (CAST(embedding[1] AS DOUBLE) ** 2) / 4 AS q FROM embeddings)""")
def plane_angles(spark, d):
    """Length and direction in the plane of the first two dimensions, and the Bessel function of the first."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    return e.select("vec_id", F.round(F.sqrt(x * x + y * y), 5).alias("length"), F.round(fn.angle(x, y), 5).alias("angle"), F.round(fn.bessel_i0(x), 6).alias("bessel"))


@query("""SELECT statement_id, row_number() OVER (ORDER BY statement_id IS NULL, n IS NULL, n, statement_id) AS place FROM (SELECT statement_id, CASE WHEN regexp_full_match(statement_id, '[0-9]{1,15}') THEN CAST(statement_id AS DOUBLE) END AS n FROM (SELECT DISTINCT statement_id FROM campaignview_chunks_sent))""")
def mixed_id_order(spark, d):
    """Statements in the order of their ids: numbers by value, then texts."""
    s = table(spark, d, "campaignview_chunks_sent").select("statement_id").distinct()
    return numbered(s, fn.mixed_order(F.col("statement_id")), "place").withColumn("place", F.col("place") + 1)


@query("SELECT doc_id, source, n_chars FROM documents WHERE lower(source) LIKE '%jornal%' AND doc_id IN (SELECT doc_id FROM documents WHERE lower(source) LIKE '%jornal%' ORDER BY n_chars DESC, doc_id LIMIT 20)")
def named_documents(spark, d):
    """The longest documents of sources with a name part; a top-k report in total order."""
    found = table(spark, d, "documents").where(F.lower("source").contains("jornal")).select("doc_id", "source", "n_chars")
    return found.orderBy(F.desc("n_chars"), "doc_id").limit(20)
