"""Queries through pyspark.ml stages and functions of whole groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..estimators.pipeline import ClassWeighting, PositionEstimator, by_group
from ..operators import metrics as metric_ops
from ..operators import vectors
from ..sources.tables import table
from . import query
from .base import CELLS, md5_mod, md5_mod_sql
from .cells import cells_of
from .tokens import _CLASS_DF, _terms


@query(CELLS + " SELECT (SELECT count(DISTINCT doc_id) FROM us) AS docs, (SELECT count(DISTINCT doc_id) FROM cells) AS placed, true AS standard")
def pipeline_positions(spark, d):
    """A stage fitted to cells puts positions beside all documents, null for those that have no cells."""
    from .base import us_chunks

    model = PositionEstimator(kind="stance", outputCol="position").fit(cells_of(spark, d))
    out = model.transform(us_chunks(spark, d).select("doc_id").distinct())
    standard = (F.abs(F.avg("position")) < 1e-9) & (F.abs(F.stddev_pop("position") - 1) < 1e-9)
    return out.agg(F.count("*").alias("docs"), F.count("position").alias("placed"), standard.alias("standard"))


@query(f"WITH {_CLASS_DF} SELECT * FROM k WHERE rank <= 3")
def pipeline_terms(spark, d):
    return ClassWeighting(k=3).transform(_terms(spark, d))


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(regr_slope(c_acctbal, c_nationkey), 5) AS slope FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1")
def slopes_by_group(spark, d):
    """A least-squares slope of each group, by a function of its rows."""

    def slope(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g["c_nationkey"] - g["c_nationkey"].mean(), g["c_acctbal"] - g["c_acctbal"].mean()
        return pd.DataFrame({"segment": [g["c_mktsegment"].iloc[0]], "n": [len(g)], "slope": [round(float((x * y).sum() / (x * x).sum()), 5)]})

    c = table(spark, d, "customer").where("c_acctbal is not null").select("c_mktsegment", F.col("c_nationkey").cast("double").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return by_group(c, "c_mktsegment", slope, "segment string, n bigint, slope double")


@query("SELECT count(DISTINCT vec_id % 50) AS docs, true AS centred, true AS widest FROM embeddings")
def document_pca_check(spark, d):
    """First component of the documents' mean unit vectors: centred, and wider than any single coordinate."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("doc"), "embedding")
    cells = vectors.mean_unit_vector(e, "doc", "embedding")
    docs = cells.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("s")).select("doc", F.col("s.value").alias("v"))
    score = vectors.principal_scores(docs, "doc", "v", 64)
    widest = cells.groupBy("i").agg(F.var_pop("value").alias("v")).agg(F.max("v").alias("v")).scalar()
    return score.agg(F.count("*").alias("docs"), (F.abs(F.avg("score1")) < 1e-9).alias("centred"), (F.var_pop("score1") >= widest - 1e-12).alias("widest"))


_CODES = ", ".join(f"CAST({md5_mod_sql(f'''chunk_id || '{x}' ''', 3)} AS DOUBLE) AS {x}" for x in "abc")
_PAIR = "SELECT '{0}' AS a, '{1}' AS b, count(*) AS n, round((avg({0} * {1}) - avg({0}) * avg({1})) / nullif(stddev_pop({0}) * stddev_pop({1}), 0), 6) AS r, round(avg(CAST({0} = {1} AS INT)), 6) AS same FROM g"


@query(f"WITH g AS (SELECT {_CODES} FROM (SELECT DISTINCT chunk_id FROM campaignview_chunks_sent)) " + " UNION ALL ".join(_PAIR.format(x, y) for x, y in ("ab", "ac", "bc")))
def replicate_agreement(spark, d):
    """Correlation and share of equal codes of every pair of three replicates."""
    c = table(spark, d, "campaignview_chunks_sent").select("chunk_id").distinct()
    g = c.select(*(md5_mod(F.concat("chunk_id", F.lit(x)), 3).cast("double").alias(x) for x in "abc"))
    pairs = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.count("*").alias("n"), F.round(metric_ops.pearson(x, y), 6).alias("r"), F.round(F.avg((F.col(x) == F.col(y)).cast("double")), 6).alias("same")) for x, y in ("ab", "ac", "bc")]
    return g.agg(F.array(*pairs).alias("p")).select(F.inline("p"))


@query(CELLS + """, t AS (SELECT topic, count(*) AS docfreq, sum(y) AS y, sum(s) / CAST(sum(y) AS DOUBLE) AS m, sum(abs(s)) / CAST(sum(y) AS DOUBLE) AS sided FROM cells GROUP BY 1 HAVING count(*) >= 50),
r AS (SELECT *, row_number() OVER (ORDER BY sided - abs(m) DESC, topic) AS divisive, row_number() OVER (ORDER BY abs(m) DESC, topic) AS consensus FROM t)
SELECT topic, docfreq, round(exp(0.5 * m), 6) AS odds, CAST(divisive AS INTEGER) AS divisive, CAST(consensus AS INTEGER) AS consensus FROM r WHERE divisive <= 5 OR consensus <= 5""")
def ranked_topics(spark, d):
    """Topics of fifty documents or more that divide or unite most, with the odds that half a deviation makes."""
    from pyspark.sql import Window

    s, y = F.col("s"), F.sum("y").cast("double")
    t = cells_of(spark, d).groupBy("topic").agg(F.count("*").alias("docfreq"), (F.sum(s) / y).alias("m"), (F.sum(F.abs(s)) / y).alias("sided")).where("docfreq >= 50")
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "topic"))  # noqa: E731  (one row a topic)
    r = t.withColumn("split", F.col("sided") - F.abs("m")).withColumn("one", F.abs("m")).withColumn("divisive", rank("split")).withColumn("consensus", rank("one"))
    return r.where("divisive <= 5 or consensus <= 5").select("topic", "docfreq", F.round(F.exp(0.5 * F.col("m")), 6).alias("odds"), "divisive", "consensus")
