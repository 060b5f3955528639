"""Queries about positions, agreement and classification quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as ops
from ..sources.tables import table
from . import query
from .base import md5_mod, md5_mod_sql

_R = "CASE WHEN count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) >= 3 THEN round(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 6) END"


@query(f"SELECT o_orderpriority, {_R.format(x='o_totalprice', y='CAST(o_custkey AS DOUBLE)')} AS r FROM orders GROUP BY 1 UNION ALL SELECT 'all', {_R.format(x='o_totalprice', y='CAST(o_custkey AS DOUBLE)')} FROM orders")
def pearson_within_group(spark, d):
    o = table(spark, d, "orders")
    r = F.round(ops.pearson("o_totalprice", "o_custkey"), 6).alias("r")
    return o.groupBy("o_orderpriority").agg(r).unionByName(o.agg(r).withColumn("o_orderpriority", F.lit("all")))


@query("""WITH x AS (SELECT p_size AS x, p_retailprice AS y FROM part), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM x)
SELECT count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS rho FROM r""")
def spearman_rank_corr(spark, d):
    return ops.spearman(table(spark, d, "part"), "p_size", "p_retailprice")


@query("""WITH m AS (SELECT l_returnflag, sum(l_quantity) AS sw, sum(l_quantity * l_discount) AS sx, sum(l_quantity * l_tax) AS sy, sum(l_quantity * l_discount * l_discount) AS sxx, sum(l_quantity * l_tax * l_tax) AS syy, sum(l_quantity * l_discount * l_tax) AS sxy FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((sxy / sw - sx * sy / (sw * sw)) / nullif(sqrt(greatest(sxx / sw - (sx / sw) ** 2, 0)) * sqrt(greatest(syy / sw - (sy / sw) ** 2, 0)), 0), 5) AS r FROM m""")
def weighted_corr(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*ops.weighted_moments("l_discount", "l_tax", "l_quantity"))
    return m.select("l_returnflag", F.round(ops.weighted_r(), 5).alias("r"))


def _coded(spark, d):
    low = lambda c: F.lower(F.trim(c))
    return table(spark, d, "stratified_stance_sample").distinct().select("sid", "language", "n_words", low("stance").alias("gold"), low("gpt_stance").alias("pred"), low("dimension").alias("dim"), low("gpt_dimension").alias("gpt_dim"))


_CODED = "coded AS (SELECT sid, language, n_words, lower(trim(stance)) AS gold, lower(trim(gpt_stance)) AS pred, lower(trim(dimension)) AS dim, lower(trim(gpt_dimension)) AS gpt_dim FROM (SELECT DISTINCT * FROM stratified_stance_sample))"


@query(f"""WITH {_CODED}, l AS (SELECT unnest(['left', 'neutral', 'right']) AS gold)
SELECT gold, count(*) FILTER (WHERE pred = 'left') AS "left", count(*) FILTER (WHERE pred = 'neutral') AS neutral, count(*) FILTER (WHERE pred = 'right') AS "right" FROM l LEFT JOIN coded USING (gold) GROUP BY gold""")
def crosstab_confusion(spark, d):
    return ops.confusion(_coded(spark, d), "gold", "pred", ["left", "neutral", "right"])


_PER = f"""WITH {_CODED}, c AS (SELECT gold AS g, pred AS p, count(*) AS n FROM coded WHERE gold IS NOT NULL AND pred IS NOT NULL GROUP BY ALL),
r AS (SELECT g AS label, n AS t, 0 AS q, CASE WHEN g = p THEN n ELSE 0 END AS c FROM c UNION ALL SELECT p, 0, n, 0 FROM c),
k AS (SELECT label, CAST(sum(t) AS BIGINT) AS t, CAST(sum(q) AS BIGINT) AS q, CAST(sum(c) AS BIGINT) AS c FROM r GROUP BY 1)"""


@query(_PER + " SELECT label, t AS support, round(c / nullif(q, 0), 6) AS precision, round(c / nullif(t, 0), 6) AS recall, round(coalesce(2 * c / nullif(t + q, 0), 0), 6) AS f1 FROM k")
def classification_metrics(spark, d):
    return ops.class_metrics(_coded(spark, d), "gold", "pred")


@query(_PER + """, s AS (SELECT CAST(sum(t) AS DOUBLE) AS n, CAST(sum(c) AS DOUBLE) AS c, avg(c / nullif(t, 0)) AS bal, avg(coalesce(2 * c / nullif(t + q, 0), 0)) AS f1, CAST(sum(t * q) AS DOUBLE) AS tq, CAST(sum(t * t) AS DOUBLE) AS tt, CAST(sum(q * q) AS DOUBLE) AS qq FROM k)
SELECT CAST(n AS BIGINT) AS n, round(c / n, 6) AS accuracy, round(bal, 6) AS balanced_accuracy, round(f1, 6) AS macro_f1, round((c * n - tq) / nullif(sqrt(n * n - qq) * sqrt(n * n - tt), 0), 6) AS mcc FROM s""")
def classification_overall(spark, d):
    return ops.overall_metrics(_coded(spark, d), "gold", "pred")


@query(f"""WITH {_CODED}, x AS (SELECT gold, CAST(n_words AS DOUBLE) AS s FROM coded WHERE gold IS NOT NULL AND n_words IS NOT NULL), r AS (SELECT gold, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x),
g AS (SELECT gold, count(*) AS positives, sum(r) AS r FROM r GROUP BY 1), n AS (SELECT count(*) AS n FROM x)
SELECT gold, positives, round((r - positives * (positives + 1) / 2.0) / nullif(CAST(positives AS DOUBLE) * (n - positives), 0), 6) AS auc FROM g, n""")
def auc_one_vs_rest(spark, d):
    return ops.auc(_coded(spark, d).withColumn("s", F.col("n_words").cast("double")), "gold", "s")


_GRID = [-0.5, 0.0, 0.5]


@query(f"""WITH {_CODED}, z AS (SELECT gold, {md5_mod_sql("sid || 'l'", 100)} / 100.0 AS l, {md5_mod_sql("sid || 'n'", 100)} / 100.0 AS n, {md5_mod_sql("sid || 'r'", 100)} / 100.0 AS r FROM coded WHERE gold IS NOT NULL AND sid IS NOT NULL),
o AS (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM (SELECT unnest([-0.5, 0, 0.5]) AS a), (SELECT unnest([-0.5, 0, 0.5]) AS b)),
p AS (SELECT a, b, gold AS g, CASE WHEN l + a >= greatest(n + b, r) THEN 'left' WHEN n + b >= r THEN 'neutral' ELSE 'right' END AS p FROM z, o),
c AS (SELECT a, b, g, p, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY ALL), t AS (SELECT a, b, g AS k, n AS t, 0 AS q, CASE WHEN g = p THEN n ELSE 0 END AS c FROM c UNION ALL SELECT a, b, p, 0, n, 0 FROM c),
k AS (SELECT a, b, k, sum(t) AS t, sum(q) AS q, sum(c) AS c FROM t GROUP BY ALL), s AS (SELECT a, b, sum(t) AS n, sum(c) AS c, sum(t * q) AS tq, sum(t * t) AS tt, sum(q * q) AS qq FROM k GROUP BY ALL)
SELECT a, b, round((c * n - tq) / nullif(sqrt(n * n - qq) * sqrt(n * n - tt), 0), 6) AS mcc FROM s""")
def threshold_grid(spark, d):
    z = _coded(spark, d).where("sid is not null").select("gold", *((md5_mod(F.concat("sid", F.lit(x)), 100) / F.lit(100.0)).alias(x) for x in "lnr"))
    return ops.threshold_grid(z, "gold", ["l", "n", "r"], ["left", "neutral", "right"], _GRID)


#: The recalibration grid: 31 offsets from -0.30 to 0.30.
_OFFSETS = [k / 50 for k in range(-15, 16)]


@query()
def offset_recalibration(spark, d):
    """MCC at all 31 x 31 offset pairs; threshold_grid is the excerpt of 3 x 3 points that its SQL twin has."""
    z = _coded(spark, d).where("sid is not null").select("gold", *((md5_mod(F.concat("sid", F.lit(x)), 100) / F.lit(100.0)).alias(x) for x in "lnr"))
    return ops.threshold_grid(z, "gold", ["l", "n", "r"], ["left", "neutral", "right"], _OFFSETS)


@query("""WITH x AS (SELECT c_mktsegment AS g, c_acctbal - 4500 AS v FROM customer), a AS (SELECT median(v) AS m FROM x WHERE g = 'BUILDING'), b AS (SELECT median(v) AS m FROM x WHERE g = 'MACHINERY')
SELECT round(count(*) FILTER (WHERE g = 'BUILDING' AND v > (SELECT m FROM b)) / nullif(count(*) FILTER (WHERE g = 'BUILDING'), 0), 6) AS a_above_b,
  round(count(*) FILTER (WHERE g = 'MACHINERY' AND v < (SELECT m FROM a)) / nullif(count(*) FILTER (WHERE g = 'MACHINERY'), 0), 6) AS b_below_a,
  round(count(*) FILTER (WHERE g = 'BUILDING' AND v > 0) / nullif(count(*) FILTER (WHERE g = 'BUILDING'), 0), 6) AS a_positive,
  round(count(*) FILTER (WHERE g = 'MACHINERY' AND v < 0) / nullif(count(*) FILTER (WHERE g = 'MACHINERY'), 0), 6) AS b_negative FROM x""")
def overlap_of_groups(spark, d):
    return ops.overlap(table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), (F.col("c_acctbal") - 4500).alias("v")), "g", "BUILDING", "MACHINERY", "v")


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, round(stddev_samp(c_acctbal), 4) AS sd, round(quantile_cont(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY 1")
def group_position_summary(spark, d):
    x = "c_acctbal"
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.median(x), 4).alias("median"), F.round(F.stddev_samp(x), 4).alias("sd"), F.round(F.percentile(x, 0.9), 4).alias("p90"))


@query("""WITH s AS (SELECT doc_id, avg(score) AS m FROM (SELECT DISTINCT chunk_id, doc_id, political, score FROM score_records) WHERE political AND score BETWEEN 0 AND 100 GROUP BY 1)
SELECT doc_id, round(m, 6) AS position FROM s""")
def ask_and_average(spark, d):
    """A document's mean score over its political chunks with a valid score."""
    s = table(spark, d, "score_records").select("chunk_id", "doc_id", "political", "score").distinct()
    return s.where("political and score between 0 and 100").groupBy("doc_id").agg(F.round(F.avg("score"), 6).alias("position"))


@query("""WITH s AS (SELECT doc_id, avg(score) AS m FROM (SELECT DISTINCT chunk_id, doc_id, political, score FROM score_records) WHERE political AND score BETWEEN 0 AND 100 GROUP BY 1),
p AS (SELECT doc_id, min(party_label) AS party FROM campaignview_chunks_sent GROUP BY 1)
SELECT coalesce(party, 'UNKNOWN') AS party, count(*) AS docs, round(avg(m), 5) AS mean_position FROM s LEFT JOIN p USING (doc_id) GROUP BY 1""")
def party_level_means(spark, d):
    s = table(spark, d, "score_records").select("chunk_id", "doc_id", "political", "score").distinct().where("political and score between 0 and 100").groupBy("doc_id").agg(F.avg("score").alias("m"))
    p = table(spark, d, "campaignview_chunks_sent").groupBy("doc_id").agg(F.min("party_label").alias("party"))
    return s.join(p, "doc_id", "left").groupBy(F.coalesce("party", F.lit("UNKNOWN")).alias("party")).agg(F.count("*").alias("docs"), F.round(F.avg("m"), 5).alias("mean_position"))


@query("""WITH n AS (SELECT party_label AS party, count(DISTINCT doc_id) AS n FROM campaignview_chunks_sent GROUP BY 1), s AS (SELECT doc_id FROM score_records GROUP BY 1), p AS (SELECT doc_id, min(party_label) AS party FROM campaignview_chunks_sent GROUP BY 1),
k AS (SELECT party, count(*) AS k FROM s JOIN p USING (doc_id) GROUP BY 1)
SELECT n.party, n, k, round(n / k, 6) AS weight FROM n JOIN k ON n.party = k.party""")
def design_weights(spark, d):
    """Documents of a stratum over those of it that were scored."""
    c = table(spark, d, "campaignview_chunks_sent")
    n = c.groupBy(F.col("party_label").alias("party")).agg(F.count_distinct("doc_id").alias("n"))
    p = c.groupBy("doc_id").agg(F.min("party_label").alias("party"))
    k = table(spark, d, "score_records").select("doc_id").distinct().join(p, "doc_id").groupBy("party").agg(F.count("*").alias("k"))
    return n.join(k, "party").select("party", "n", "k", F.round(F.col("n") / F.col("k"), 6).alias("weight"))


@query("""WITH s AS (SELECT DISTINCT doc_id FROM score_records), t AS (SELECT DISTINCT doc_id FROM chunk_topics WHERE topic >= 0), c AS (SELECT DISTINCT doc_id FROM campaignview_chunks_sent)
SELECT count(*) AS docs, count(t.doc_id) AS with_topic, count(s.doc_id) AS with_score, count(*) FILTER (WHERE t.doc_id IS NOT NULL AND s.doc_id IS NOT NULL) AS with_both FROM c LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)""")
def coverage_counts(spark, d):
    has = lambda df, n: df.select("doc_id").distinct().withColumn(n, F.lit(True))
    c = table(spark, d, "campaignview_chunks_sent").select("doc_id").distinct()
    j = c.join(has(table(spark, d, "chunk_topics").where("topic >= 0"), "t"), "doc_id", "left").join(has(table(spark, d, "score_records"), "s"), "doc_id", "left")
    return j.agg(F.count("*").alias("docs"), F.count("t").alias("with_topic"), F.count("s").alias("with_score"), F.count_if(F.col("t") & F.col("s")).alias("with_both"))


@query("""WITH g AS (SELECT o_orderpriority AS measure, o_orderstatus AS model, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY ALL) SELECT *, value = max(value) OVER (PARTITION BY measure) AS best FROM g""")
def comparison_best_flag(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("measure"), F.col("o_orderstatus").alias("model")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    return ops.best_flag(g, "measure", "value")


@query(f"WITH {_CODED} SELECT dim, count(*) AS n, count(*) FILTER (WHERE dim = gpt_dim) AS same_dim, count(*) FILTER (WHERE dim = gpt_dim AND gold = pred) AS concordant FROM coded WHERE dim IS NOT NULL GROUP BY dim")
def concordance_filter(spark, d):
    """How many coded sentences agree on dimension, and on stance as well."""
    same, both = F.col("dim") == F.col("gpt_dim"), F.col("gold") == F.col("pred")
    return _coded(spark, d).where("dim is not null").groupBy("dim").agg(F.count("*").alias("n"), F.count_if(same).alias("same_dim"), F.count_if(same & both).alias("concordant"))


@query(f"""WITH {_CODED}, w AS (SELECT gold, pred, count(*) AS n FROM coded WHERE gold IS NOT NULL AND pred IS NOT NULL GROUP BY ALL), t AS (SELECT gold, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE gold <> pred) AS BIGINT) AS wrong FROM w GROUP BY 1),
a AS (SELECT gold, pred, n, row_number() OVER (PARTITION BY gold ORDER BY n DESC, pred) AS r FROM w WHERE gold <> pred)
SELECT t.gold, total, wrong, a.pred AS top_alternative, round(a.n / wrong, 6) AS alternative_share FROM t JOIN a ON a.gold = t.gold AND r = 1""")
def dominant_alternative(spark, d):
    """Per gold label: disagreements, the commonest wrong label and its share of them."""
    w = _coded(spark, d).where("gold is not null and pred is not null").groupBy("gold", "pred").agg(F.count("*").alias("n"))
    off = F.col("gold") != F.col("pred")
    best = F.min(F.when(off, F.struct(F.negative("n").alias("m"), "pred")))
    g = w.groupBy("gold").agg(F.sum("n").alias("total"), F.sum(F.when(off, F.col("n"))).alias("wrong"), best.alias("b")).where("b is not null")
    return g.select("gold", "total", "wrong", F.col("b.pred").alias("top_alternative"), F.round(F.negative(F.col("b.m")) / F.col("wrong"), 6).alias("alternative_share"))


@query("""WITH b AS (SELECT least(greatest(CAST(floor((c_acctbal + 1000) / 11000 * 36) AS BIGINT), 0), 35) AS bin FROM customer WHERE c_acctbal IS NOT NULL) SELECT bin, round(100.0 * count(*) / (SELECT count(*) FROM b), 6) AS percent FROM b GROUP BY bin""")
def histogram_percent(spark, d):
    """Shares of 36 bins, values beyond the edges in the outer ones: the frame behind a density figure."""
    b = table(spark, d, "customer").where("c_acctbal is not null").select(F.least(F.greatest(F.floor((F.col("c_acctbal") + 1000) / 11000 * 36), F.lit(0)), F.lit(35)).alias("bin"))
    n = b.agg(F.count("*").alias("n")).scalar()
    return b.groupBy("bin").agg(F.count("*").alias("k")).select("bin", F.round(F.lit(100.0) * F.col("k") / n, 6).alias("percent"))


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def validation_line(spark, d):
    """The least-squares line of one scale on another by group: the frame behind a validation scatter."""
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query(f"""WITH {_CODED}
SELECT language, gold, count(*) AS n, count(*) FILTER (WHERE n_words >= 8) AS long_enough, CAST(max(n_words) AS BIGINT) AS longest FROM coded WHERE gold IS NOT NULL AND language IS NOT NULL GROUP BY ALL""")
def training_pool(spark, d):
    """Coded sentences by language and stance, with those that pass the length floor."""
    p = _coded(spark, d).where("gold is not null and language is not null")
    return p.groupBy("language", "gold").agg(F.count("*").alias("n"), F.count_if(F.col("n_words") >= 8).alias("long_enough"), F.max("n_words").cast("bigint").alias("longest"))
