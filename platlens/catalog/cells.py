"""Queries about cells, classes and composition."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from ..operators import cells as ops
from ..sources.tables import table
from . import query
from .base import CELLS, US, us_chunks


def _signed(spark, d):
    return ops.keep_large_groups(ops.reroute_short(us_chunks(spark, d)), "doc_id", 5)


def cells_of(spark, d):
    return ops.cell_table(_signed(spark, d))


@query(CELLS + """ SELECT topic, count(*) AS docfreq, CAST(sum(y) AS BIGINT) AS y, round(CAST(sum(s) AS DOUBLE) / sum(y), 6) AS mean_stance,
  round(CAST(sum(y) AS DOUBLE) / (SELECT sum(y) FROM cells), 6) AS share FROM cells GROUP BY topic""")
def topic_salience(spark, d):
    return ops.topic_totals(cells_of(spark, d))


@query(CELLS + " SELECT doc_id, topic, y, s, round(CAST(s AS DOUBLE) / y, 6) AS mean_stance FROM cells")
def cell_table(spark, d):
    return cells_of(spark, d).withColumn("mean_stance", F.round("mean_stance", 6))


@query(CELLS + " SELECT topic, count(*) AS docfreq FROM cells GROUP BY topic")
def docfreq_by_topic(spark, d):
    return cells_of(spark, d).groupBy("topic").agg(F.count("*").alias("docfreq"))


@query(f"WITH {US} SELECT chunk_id, CAST(CASE WHEN word_count <= 6 THEN -2 ELSE topic END AS INTEGER) AS topic FROM us WHERE word_count <= 6 OR topic >= 0")
def short_chunk_reroute(spark, d):
    return ops.reroute_short(us_chunks(spark, d)).select("chunk_id", F.col("topic").cast("int").alias("topic"))


@query(f"WITH {US} SELECT doc_id, count(*) AS chunks FROM us GROUP BY doc_id HAVING count(*) >= 10")
def min_chunks_docs(spark, d):
    return ops.keep_large_groups(us_chunks(spark, d), "doc_id", 10).groupBy("doc_id").agg(F.count("*").alias("chunks"))


_CROSSWALK = "(SELECT DISTINCT topic, CASE WHEN topic = -2 THEN 'SHO' WHEN topic % 4 = 3 THEN NULL ELSE chr(65 + CAST(topic % 4 AS INTEGER)) || 'XX' END AS code FROM cells)"


def _crosswalk(cells):
    t = F.col("topic")
    code = F.when(t == -2, "SHO").when(t % 4 == 3, None).otherwise(F.concat(F.char((t % 4 + 65).cast("bigint")), F.lit("XX")))
    return cells.select("topic").distinct().withColumn("code", code).where("code is not null")


@query(CELLS + f" SELECT doc_id, code, CAST(sum(y) AS BIGINT) AS y, CAST(sum(s) AS BIGINT) AS s FROM cells JOIN {_CROSSWALK} x USING (topic) WHERE code IS NOT NULL GROUP BY ALL")
def crosswalk_rollup(spark, d):
    c = cells_of(spark, d)
    return ops.roll_up(c, _crosswalk(c))


@query(CELLS + f" SELECT topic, CAST(sum(y) AS BIGINT) AS y FROM cells JOIN {_CROSSWALK} x USING (topic) WHERE code IS NULL GROUP BY topic")
def crosswalk_uncovered(spark, d):
    c = cells_of(spark, d)
    return ops.uncovered(c, _crosswalk(c))


@query(CELLS + f""", m AS (SELECT doc_id, code, sum(y) AS y FROM cells JOIN {_CROSSWALK} x USING (topic) WHERE code IS NOT NULL GROUP BY ALL)
SELECT doc_id, CAST(sum(CASE WHEN code NOT IN ('SHO', 'AXX') THEN y ELSE 0 END) AS BIGINT) AS y_left, bool_and(code IN ('SHO', 'AXX')) AS emptied FROM m GROUP BY doc_id""")
def drop_class_then_empty_docs(spark, d):
    c = cells_of(spark, d)
    kept, gone = ops.drop_classes(ops.roll_up(c, _crosswalk(c)), ["SHO", "AXX"])
    left = kept.groupBy("doc_id").agg(F.sum("y").alias("y_left")).withColumn("emptied", F.lit(False))
    return left.unionByName(gone.select("doc_id", F.lit(0).cast("bigint").alias("y_left"), F.lit(True).alias("emptied")))





@query(CELLS + ' SELECT topic, count(*) AS n, round(avg(CAST(stance < 0 AS INT)), 6) AS "left", round(avg(CAST(stance = 0 AS INT)), 6) AS neutral, round(avg(CAST(stance > 0 AS INT)), 6) AS "right" FROM big GROUP BY topic HAVING count(*) >= 20')
def stance_composition_chunks(spark, d):
    return ops.stance_composition(_signed(spark, d), least=20)


@query(CELLS + ', g AS (SELECT topic, CAST(sum(y) AS BIGINT) AS n, CAST(sum(abs(s)) AS DOUBLE) AS a, CAST(sum(s) AS DOUBLE) AS s FROM cells GROUP BY topic) SELECT topic, n, round((a - s) / 2 / n, 6) AS "left", round((n - a) / n, 6) AS neutral, round((a + s) / 2 / n, 6) AS "right" FROM g WHERE n >= 20')
def stance_composition_cells(spark, d):
    return ops.composition_of_cells(cells_of(spark, d), least=20)


_PARTY = "p AS (SELECT doc_id, min(party_label) AS party FROM big GROUP BY doc_id)"


@query(CELLS + f""", {_PARTY}, t AS (SELECT topic, sum(CASE WHEN party = 'Democratic' THEN y ELSE 0 END) AS ya, sum(CASE WHEN party = 'Republican' THEN y ELSE 0 END) AS yb FROM cells JOIN p USING (doc_id) GROUP BY topic),
s AS (SELECT topic, round(CAST(ya AS DOUBLE) / (SELECT sum(ya) FROM t), 6) AS share_a, round(CAST(yb AS DOUBLE) / (SELECT sum(yb) FROM t), 6) AS share_b FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY share_a DESC, topic) AS rank_a, row_number() OVER (ORDER BY share_b DESC, topic) AS rank_b FROM s)
SELECT *, CASE WHEN rank_a <= 5 AND rank_b <= 5 THEN 'both' WHEN rank_a <= 5 THEN 'a' WHEN rank_b <= 5 THEN 'b' ELSE 'none' END AS top FROM r""")
def agenda_overlap_topk(spark, d):
    party = _signed(spark, d).groupBy("doc_id").agg(F.min("party_label").alias("party"))
    return ops.agenda_overlap(cells_of(spark, d).join(party, "doc_id"), "party", "Democratic", "Republican", k=5)


@query(CELLS + """, g AS (SELECT topic, count(*) AS docfreq, CAST(sum(s) AS DOUBLE) / sum(y) AS m, CAST(sum(y) AS BIGINT) AS y FROM cells GROUP BY topic HAVING count(*) >= 5),
r AS (SELECT topic, docfreq, round(m, 6) AS mean_stance, y, row_number() OVER (ORDER BY round(abs(m), 6) DESC, topic) AS divisive, row_number() OVER (ORDER BY round(abs(m), 6), topic) AS consensus, row_number() OVER (ORDER BY y DESC, topic) AS salience FROM g)
SELECT * FROM r WHERE least(divisive, consensus, salience) <= 5""")
def ranked_loadings(spark, d):
    from pyspark.sql import Window

    g = cells_of(spark, d).groupBy("topic").agg(F.count("*").alias("docfreq"), (F.sum("s").cast("double") / F.sum("y")).alias("m"), F.sum("y").alias("y")).where("docfreq >= 5")
    a = F.round(F.abs("m"), 6)
    rank = lambda *o: F.row_number().over(Window.orderBy(*o)).cast("bigint")
    r = g.withColumn("divisive", rank(a.desc(), "topic")).withColumn("consensus", rank(a, "topic")).withColumn("salience", rank(F.desc("y"), "topic"))
    return r.where(F.least("divisive", "consensus", "salience") <= 5).select("topic", "docfreq", F.round("m", 6).alias("mean_stance"), "y", "divisive", "consensus", "salience")


@query("""WITH m AS (SELECT platform_id AS doc_id, min(upper(trim(party))) AS party, bool_or(valid_mayor_platform) AS valid, bool_or(has_pdf) AS pdf FROM platform_party_map GROUP BY 1),
c AS (SELECT DISTINCT doc_id FROM br_manifestos_chunks_sent)
SELECT count(*) AS platforms, count(*) FILTER (WHERE pdf) AS with_pdf, count(*) FILTER (WHERE pdf AND valid) AS valid, count(*) FILTER (WHERE pdf AND valid AND c.doc_id IS NOT NULL) AS with_text,
  count(*) FILTER (WHERE pdf AND valid AND c.doc_id IS NOT NULL AND party IS NOT NULL) AS with_party FROM m LEFT JOIN c USING (doc_id)""")
def corpus_funnel(spark, d):
    """How many platforms survive each condition, in order."""
    m = table(spark, d, "platform_party_map").groupBy(F.col("platform_id").alias("doc_id")).agg(F.min(F.upper(F.trim("party"))).alias("party"), F.bool_or("valid_mayor_platform").alias("valid"), F.bool_or("has_pdf").alias("pdf"))
    c = table(spark, d, "br_manifestos_chunks_sent").select("doc_id").distinct().withColumn("has", F.lit(True))
    steps, names = [F.lit(True), F.col("pdf"), F.col("valid"), F.col("has"), F.col("party").isNotNull()], ["platforms", "with_pdf", "valid", "with_text", "with_party"]
    conditions = [F.coalesce(reduce(and_, steps[: i + 1]), F.lit(False)) for i in range(len(steps))]
    return m.join(c, "doc_id", "left").agg(*(F.count_if(x).alias(n) for x, n in zip(conditions, names)))
