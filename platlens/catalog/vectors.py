"""Queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as ops
from ..sources.tables import table
from . import query

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e)"


@query(f"""WITH {_E}, s AS (SELECT q.vec_id AS query, b.vec_id AS neighbour, b.label, round(list_dot_product(q.u, b.u), 9) AS s FROM u q JOIN u b ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS k FROM s), n AS (SELECT query, label, count(*) AS votes FROM r WHERE k <= 10 GROUP BY ALL)
SELECT query, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) AS k FROM n) WHERE k = 1""")
def knn_majority(spark, d):
    e = table(spark, d, "embeddings")
    return ops.majority(ops.knn(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10), e, "vec_id", "label")


@query(f"""WITH {_E}, c AS (SELECT label AS c, i, avg(u[i]) AS v FROM (SELECT label, u, unnest(range(1, 65)) AS i FROM u) GROUP BY ALL), g AS (SELECT c, list(v ORDER BY i) AS v FROM c GROUP BY c),
h AS (SELECT c, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM g), s AS (SELECT vec_id, label AS own, c, round(list_dot_product(u, v), 9) AS s FROM u, h)
SELECT vec_id, c AS nearest, own, c = own AS same FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS k FROM s) WHERE k = 1""")
def nearest_centroid(spark, d):
    return ops.nearest_centroid(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query(f"WITH {_E} SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(u[i]), 6) AS value FROM (SELECT label, u, unnest(range(1, 65)) AS i FROM u) GROUP BY ALL")
def doc_mean_unit_vector(spark, d):
    return ops.mean_unit_vector(table(spark, d, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 6))


_Z = "z AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), t AS (SELECT *, greatest(a, b, c) AS m FROM z), x AS (SELECT *, exp(a - m) + exp(b - m) + exp(c - m) AS s FROM t)"


@query(f"WITH {_Z} SELECT vec_id, round(exp(a - m) / s, 6) AS p_left, round(exp(b - m) / s, 6) AS p_right, round(exp(c - m) / s, 6) AS p_neutral, CASE WHEN a = m THEN 'Left' WHEN b = m THEN 'Right' ELSE 'Neutral' END AS stance FROM x")
def softmax_argmax(spark, d):
    z = table(spark, d, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("abc")))
    p = z.select("vec_id", *ops.softmax(["a", "b", "c"], ["Left", "Right", "Neutral"]))
    return p.select("vec_id", *(F.round(c, 6).alias(c) for c in ("p_left", "p_right", "p_neutral")), "stance")


@query("SELECT vec_id, CASE WHEN label % 3 = 0 THEN CASE WHEN embedding[1] >= embedding[2] THEN 'Left' ELSE 'Right' END WHEN label % 3 = 1 THEN CASE WHEN embedding[3] >= embedding[4] THEN 'Left' ELSE 'Right' END ELSE 'Neutral' END AS stance FROM embeddings")
def routed_classification(spark, d):
    """The route (here the label) decides which pair of logits speaks."""
    x = lambda i: F.get("embedding", F.lit(i))
    pick = lambda a, b: F.when(x(a) >= x(b), "Left").otherwise("Right")
    route = F.col("label") % 3
    return table(spark, d, "embeddings").select("vec_id", F.when(route == 0, pick(0, 1)).when(route == 1, pick(2, 3)).otherwise("Neutral").alias("stance"))


@query()
def embedding_pca(spark, d):
    return ops.principal_scores(table(spark, d, "embeddings"), "vec_id", "embedding", 64)


@query("SELECT true AS centred, true AS ordered, true AS uncorrelated")
def pca_check(spark, d):
    """What must hold of principal components: scores have mean 0, falling variances and no correlation."""
    s = ops.principal_scores(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 3)
    m = s.agg(*(F.avg(f"score{k}").alias(f"m{k}") for k in (1, 2, 3)), *(F.var_pop(f"score{k}").alias(f"v{k}") for k in (1, 2, 3)), F.covar_pop("score1", "score2").alias("c"))
    return m.select((F.greatest(*(F.abs(f"m{k}") for k in (1, 2, 3))) < 1e-6).alias("centred"), ((F.col("v1") >= F.col("v2")) & (F.col("v2") >= F.col("v3"))).alias("ordered"), (F.abs("c") < 1e-6).alias("uncorrelated"))


@query("SELECT count(*) AS rows, count(*) AS in_nearest FROM embeddings")
def kmeans_check(spark, d):
    """Rows, and those whose cluster is the one with the nearest mean of its members, by squared distance of converged means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = table(spark, d, "embeddings").select("vec_id", "embedding", array_to_vector("embedding").alias("features"))
    model = KMeans(k=10, seed=7, maxIter=100, tol=0.0).fit(x)
    centres = F.array(*(F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()))
    far = lambda c: F.aggregate(F.zip_with("embedding", c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    every = model.transform(x).select("prediction", F.transform(centres, far).alias("ds"))
    near = F.get("ds", F.col("prediction")) <= F.array_min("ds") + 1e-9
    return every.agg(F.count("*").alias("rows"), F.count_if(near).alias("in_nearest"))


@query()
def kmeans_topics(spark, d):
    """Clusters of embeddings by k-means, the declared substitute for density clustering."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=10, seed=7, maxIter=20).fit(x).transform(x).select("vec_id", F.col("prediction").alias("topic"))


@query()
def purified_topics(spark, d):
    """Labels whose documents are few give their rows to the labels of the nearest others."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    spread = e.groupBy("label").agg(F.count("*").cast("double").alias("spread"))
    least = spread.agg(F.percentile("spread", 0.2).alias("q")).first().q
    return ops.purify(e, "vec_id", "embedding", "label", spread, least)
