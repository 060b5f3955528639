"""Queries that fit positions and topic models."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..estimators import joint as joint_model
from ..estimators import wordvectors
from ..estimators.counts import correspondence, fit_counts, fit_poisson, poisson_errors
from ..estimators.nmf import fit_nmf
from ..estimators.packed import Packed
from ..estimators.stance import fit_stance, fit_stance_ridge
from ..operators import frames, tokens
from ..sources.tables import table
from . import query
from .base import CELLS, US, us_chunks
from .cells import cells_of
from .tokens import _chunks


def _packed(spark: SparkSession, d: str) -> Packed:
    return Packed.of(cells_of(spark, d))


def _positions(p: Packed) -> DataFrame:
    return p.table.select(F.col("doc").alias("doc_id"), F.round("theta", 6).alias("theta"))


def _items(spark: SparkSession, p: Packed, **values: np.ndarray) -> DataFrame:
    rows = [(t, *(float(v[i]) for v in values.values())) for i, t in enumerate(p.items)]
    return spark.createDataFrame(rows, "topic int, " + ", ".join(f"{k} double" for k in values))


@query(CELLS + """, c AS (SELECT doc_id, topic, CAST(y AS DOUBLE) AS y, s / CAST(y AS DOUBLE) AS m FROM cells), r AS (SELECT doc_id, sum(y * m) / sum(y) AS raw FROM c GROUP BY 1),
t AS (SELECT doc_id, (raw - (SELECT avg(raw) FROM r)) / (SELECT stddev_pop(raw) FROM r) AS t FROM r),
k AS (SELECT topic, sum(y) AS w, sum(y * t) AS wt, sum(y * t * t) AS wtt, sum(y * m) AS ws, sum(y * t * m) AS wts FROM c JOIN t USING (doc_id) GROUP BY 1)
SELECT topic, round(ws / w - (wts - wt * ws / w) / (wtt - wt * wt / w) * wt / w, 6) AS alpha, round((wts - wt * ws / w) / (wtt - wt * wt / w), 6) AS beta FROM k WHERE wtt - wt * wt / w > 1e-9""")
def stance_als_1sweep(spark, d):
    """The first item update in plain aggregates: standardized mean stances, then a weighted line per topic."""
    c = cells_of(spark, d).select("doc_id", "topic", F.col("y").cast("double").alias("y"), F.col("mean_stance").alias("m"))
    r = c.groupBy("doc_id").agg((F.sum(F.col("y") * F.col("m")) / F.sum("y")).alias("raw"))
    s = r.agg(F.avg("raw").alias("mean"), F.stddev_pop("raw").alias("sd"))
    t = r.select("doc_id", ((F.col("raw") - s.select("mean").scalar()) / s.select("sd").scalar()).alias("t"))
    y, x, m = F.col("y"), F.col("t"), F.col("m")
    k = c.join(t, "doc_id").groupBy("topic").agg(F.sum(y).alias("w"), F.sum(y * x).alias("wt"), F.sum(y * x * x).alias("wtt"), F.sum(y * m).alias("ws"), F.sum(y * x * m).alias("wts"))
    v = lambda n: F.col(n)
    k = k.withColumn("sxx", v("wtt") - v("wt") * v("wt") / v("w")).where("sxx > 1e-9").withColumn("beta", (v("wts") - v("wt") * v("ws") / v("w")) / v("sxx"))
    return k.select("topic", F.round(v("ws") / v("w") - v("beta") * v("wt") / v("w"), 6).alias("alpha"), F.round("beta", 6).alias("beta"))


def _flags(spark: SparkSession, **flags: bool) -> DataFrame:
    """One row that says of each property of a fit whether it holds."""
    return spark.createDataFrame([tuple(bool(v) for v in flags.values())], ", ".join(f"{k} boolean" for k in flags))


def _true(*names: str) -> str:
    return "SELECT " + ", ".join(f"true AS {n}" for n in names)


def _falling(losses: list[float]) -> bool:
    return all(b <= a + 1e-9 * (1 + abs(a)) for a, b in zip(losses, losses[1:]))


def _mean_and_deviation(p: Packed) -> tuple[float, float]:
    n, a, q = p.sums(lambda b: np.array([float(b.documents), b.theta.sum(), (b.theta**2).sum()]))
    return a / n, float(np.sqrt(max(q / n - (a / n) ** 2, 0.0)))


@query()
def stance_als_fit(spark, d):
    return _positions(fit_stance(_packed(spark, d)).packed)


@query()
def stance_als_items(spark, d):
    f = fit_stance(_packed(spark, d))
    return _items(spark, f.packed, alpha=f.alpha, beta=f.beta)


def _normal_equations(p: Packed, alpha: np.ndarray, beta: np.ndarray) -> float:
    """How far lines are from the least-squares ones at the positions of p, in mean stance a cell."""
    t = len(p.items)

    def f(b) -> np.ndarray:
        w, x = b.weight[b.doc] * b.y, b.theta[b.doc]
        left = b.s / b.y - alpha[b.item] - beta[b.item] * x
        return np.concatenate([b.by_item(w * left, t), b.by_item(w * x * left, t), b.by_item(w, t)])

    m = p.sums(f).reshape(3, t)
    return float(np.abs(m[:2] / np.maximum(m[2], 1.0)).max())


@query(_true("descends", "standard", "normal_equations", "variance_positive"))
def stance_als_check(spark, d):
    """What must hold of the stance fit: its loss falls, positions are standardized, lines solve their normal equations."""
    f = fit_stance(_packed(spark, d))
    mean, sd = _mean_and_deviation(f.packed)
    return _flags(spark, descends=_falling(f.losses), standard=abs(mean) < 1e-9 and abs(sd - 1) < 1e-9, normal_equations=_normal_equations(f.packed, f.alpha, f.beta) < 1e-9, variance_positive=f.sigma2 > 0)


@query()
def stance_ridge_fit(spark, d):
    """Positions of the plain factor model of mean stances, with a ridge."""
    return _positions(fit_stance_ridge(_packed(spark, d)).packed)


@query(_true("standard", "normal_equations"))
def stance_ridge_check(spark, d):
    f = fit_stance_ridge(_packed(spark, d))
    mean, sd = _mean_and_deviation(f.packed)
    return _flags(spark, standard=abs(mean) < 1e-9 and abs(sd - 1) < 1e-9, normal_equations=_normal_equations(f.packed, f.alpha, f.beta) < 1e-9)


@query()
def joint_fit(spark, d):
    return _positions(joint_model.fit_joint(_packed(spark, d)).packed)


@query()
def joint_items(spark, d):
    """Item parameters of the joint fit with robust standard errors."""
    j = joint_model.fit_joint(_packed(spark, d))
    se = joint_model.sandwich(j)
    c = j.counts
    return _items(spark, j.packed, alpha=j.alpha, beta=j.beta, lam=c.lam, rho=c.rho, kap=c.kap, se_alpha=se[0], se_beta=se[1], se_lam=se[2], se_rho=se[3], se_kap=se[4])


@query(_true("descends", "settled", "centred", "errors_positive", "reflects", "intercepts"))
def joint_check(spark, d):
    """What must hold of the joint fit: sweeps lower the loss until they add little, it is identified, errors are finite and
    positive, a benchmark against it reflects it, and profiled intercepts give every document its count back."""
    j = joint_model.fit_joint(_packed(spark, d))
    c, se = j.counts, joint_model.sandwich(j)
    mean, _ = _mean_and_deviation(j.packed)
    against = j.packed.table.select(F.col("doc").alias("doc_id"), F.negative("theta").alias("benchmark"), F.substring("doc", 1, 1).alias("party"))
    back = [joint_model.oriented(j, against), joint_model.oriented(j, against.withColumn("benchmark", F.lit(1.0)), party="party")]
    placed = joint_model.document_intercepts(j)
    totals = placed.sums(lambda b: np.array([(np.exp(b.theta) > 0).sum() - b.documents]))
    centred = abs(mean) < 1e-8 and abs((j.beta**2).mean() - 1) < 1e-8 and max(abs(c.lam.mean()), abs(c.rho.mean()), abs(c.kap.mean())) < 1e-8
    return _flags(spark, descends=_falling(j.losses), settled=len(j.losses) <= 31, centred=centred, errors_positive=bool(np.isfinite(se).all() and (se > 0).all()), reflects=np.allclose(back[0].beta, -j.beta) and np.allclose(back[1].beta, j.beta), intercepts=float(totals[0]) == 0)


@query()
def fit_traces(spark, d):
    """Losses by step of the fits of one table: the frame behind a convergence figure."""
    p = _packed(spark, d)
    stance = fit_stance(p)
    runs = {"stance": stance.losses, "joint": joint_model.fit_joint(p, stance=stance).losses, "counts": fit_counts(stance.packed).losses}
    return spark.createDataFrame(frames.traces(runs), "run string, step int, loss double")


@query()
def two_stage_fit(spark, d):
    return _positions(joint_model.fit_two_stage(_packed(spark, d)).packed)


@query(_true("descends", "linear", "flat"))
def two_stage_check(spark, d):
    """What must hold of the two-stage fit: scoring by both blocks lowers the loss, without curvature, to a flat gradient."""
    j = joint_model.fit_two_stage(_packed(spark, d))
    p = joint_model._parameters(j)
    worst = j.packed.sums(lambda b: np.array([(np.abs((x := joint_model._terms(b, b.theta, p))[1]) > 1e-3 * x[2]).sum()]))
    return _flags(spark, descends=_falling(j.losses), linear=bool((j.counts.kap == 0).all()), flat=float(worst[0]) == 0)


@query()
def fit_grid_positions(spark, d):
    """Positions of the joint fit at two levels of topics, with and without the discount of counts."""
    cells = cells_of(spark, d)
    macro = cells.withColumn("topic", F.floor(F.col("topic") / 4)).groupBy("doc_id", "topic").agg(F.sum("y").alias("y"), F.sum("s").alias("s"))
    fits = joint_model.fit_grid({"micro": Packed.of(cells), "macro": Packed.of(macro)})
    parts = [_positions(j.packed).select(F.lit(level).alias("level"), F.lit(variant).alias("variant"), "doc_id", "theta") for (level, variant), j in fits.items()]
    return reduce(DataFrame.unionByName, parts)


@query(CELLS + " SELECT topic, count(*) AS docfreq, CAST(sum(y) AS BIGINT) AS y FROM cells GROUP BY topic")
def fit_alignment(spark, d):
    """Cells of the documents and topics that a fit used, with their document frequency counted again."""
    cells, p = cells_of(spark, d), _packed(spark, d)
    docs = p.table.select(F.col("doc").alias("doc_id"))
    topics = spark.createDataFrame([(t,) for t in p.items], "topic int")
    kept = cells.join(docs, "doc_id", "left_semi").join(F.broadcast(topics), "topic", "left_semi")
    return kept.groupBy("topic").agg(F.count("*").alias("docfreq"), F.sum("y").alias("y"))


_CODED_CELLS = f"""{US}, r AS (SELECT chunk_id, max_by(political, (created_at, received_at, id)) AS political, max_by(coalesce(score, -1), (created_at, received_at, id)) AS score FROM score_records WHERE chunk_id IS NOT NULL GROUP BY 1),
k AS (SELECT u.doc_id, u.topic, CASE WHEN political THEN 2.0 * score / 100 - 1 ELSE 0 END AS v FROM us u JOIN r USING (chunk_id) WHERE topic >= 0 AND political IS NOT NULL AND (NOT political OR score BETWEEN 0 AND 100)),
n AS (SELECT party_label AS party, count(DISTINCT doc_id) AS n FROM us WHERE party_label IS NOT NULL GROUP BY 1), p AS (SELECT doc_id, min(party_label) AS party FROM us GROUP BY 1), kp AS (SELECT party, count(DISTINCT doc_id) AS k FROM k JOIN p USING (doc_id) GROUP BY 1), w AS (SELECT doc_id, n / k AS weight FROM p JOIN n USING (party) JOIN kp USING (party))"""


def _coded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(cells, weights) of a coder's scores: the last score of each chunk from -1 to 1, 0 if not political, none if missing;
    documents weigh as many of their party as they stand for."""
    chunks = us_chunks(spark, d)
    last = F.struct("created_at", "received_at", "id")
    r = table(spark, d, "score_records").where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by("political", last).alias("political"), F.max_by(F.coalesce("score", F.lit(-1)), last).alias("score"))
    usable = r.where("political is not null and (not political or score between 0 and 100)")
    v = F.when(F.col("political"), 2.0 * F.col("score") / 100 - 1).otherwise(0.0)
    cells = chunks.where("topic >= 0").join(usable, "chunk_id").groupBy("doc_id", "topic").agg(F.count("*").alias("y"), F.sum(v).alias("s"))
    party = chunks.groupBy("doc_id").agg(F.min("party_label").alias("party"))
    n = chunks.where("party_label is not null").groupBy(F.col("party_label").alias("party")).agg(F.count_distinct("doc_id").alias("n"))
    k = cells.select("doc_id").distinct().join(party, "doc_id").groupBy("party").agg(F.count("*").alias("k"))
    return cells, party.join(n, "party").join(k, "party").select("doc_id", (F.col("n") / F.col("k")).alias("weight"))


@query(f"WITH {_CODED_CELLS} SELECT k.doc_id, topic, count(*) AS y, round(sum(v), 6) AS s, round(coalesce(any_value(weight), 1), 6) AS weight FROM k LEFT JOIN w USING (doc_id) GROUP BY ALL")
def coded_cells(spark, d):
    """The cells and design weights of a coder's scores."""
    cells, weights = _coded(spark, d)
    return cells.join(weights, "doc_id", "left").select("doc_id", "topic", "y", F.round("s", 6).alias("s"), F.round(F.coalesce("weight", F.lit(1.0)), 6).alias("weight"))


@query()
def coder_fit(spark, d):
    """The joint fit of a coder's scores, with design weights."""
    cells, weights = _coded(spark, d)
    return _positions(joint_model.fit_joint(Packed.of(cells, weight=weights)).packed)


@query()
def poisson_irt(spark, d):
    return _positions(fit_poisson(_packed(spark, d)).packed)


@query()
def poisson_position_errors(spark, d):
    """Positions of the count model with their standard errors."""
    f = fit_poisson(_packed(spark, d))
    se, _ = poisson_errors(f)
    return _positions(f.packed).join(se.table.select(F.col("doc").alias("doc_id"), F.round("theta", 6).alias("se")), "doc_id")


@query(_true("standard", "sign", "errors_positive"))
def poisson_check(spark, d):
    """What must hold of the count model: positions standardized, the largest loading positive, errors finite and positive."""
    f = fit_poisson(_packed(spark, d))
    mean, sd = _mean_and_deviation(f.packed)
    se, of_items = poisson_errors(f)
    bad = se.sums(lambda b: np.array([(~(np.isfinite(b.theta) & (b.theta > 0))).sum()]))
    return _flags(spark, standard=abs(mean) < 1e-6 and abs(sd - 1) < 1e-6, sign=f.beta[np.abs(f.beta).argmax()] > 0, errors_positive=float(bad[0]) == 0 and bool(np.isfinite(of_items).all() and (of_items > 0).all()))


#: Vocabularies that word scaling tries, from all kept words down, until all positions are finite.
CASCADE = (None, 8000, 5000, 3000, 2000)


def _words(spark: SparkSession, d: str, target: int | None = None) -> Packed:
    dfm = tokens.fold_rare(_chunks(spark, d), "doc_id", "tokens", 20, 10)
    dfm = dfm if target is None else tokens.fold_to_target(dfm, "doc_id", target)
    return Packed.of(dfm.select("doc_id", F.col("token").alias("topic"), F.col("n").alias("y"), F.lit(0).alias("s")))


@query()
def wordfish(spark, d):
    """Word counts, capped at 50, on one axis; of the vocabularies of the cascade the first that gives finite positions."""
    for target in CASCADE:
        fit = fit_poisson(_words(spark, d, target), cap=50.0)
        if float(fit.packed.sums(lambda b: np.array([(~np.isfinite(b.theta)).sum()]))[0]) == 0:
            return _positions(fit.packed)
    raise FloatingPointError("no vocabulary gives finite positions")


@query()
def corresp_analysis(spark, d):
    """First axis of all kept words."""
    return _positions(correspondence(_words(spark, d))[0])


@query(_true("standard", "transition"))
def corresp_check(spark, d):
    """What must hold of the axis: weighted positions are standardized, and each item's score is the mean position of its
    documents over the singular value."""
    p = _words(spark, d)
    placed, u, sigma = correspondence(p)
    t = len(p.items)

    def f(b) -> np.ndarray:
        r = b.by_doc(b.y)
        return np.concatenate([b.by_item(b.y * b.theta[b.doc], t), b.by_item(b.y, t), [r.sum(), (r * b.theta).sum(), (r * b.theta**2).sum()]])

    m = placed.sums(f)
    n, a, q = m[2 * t :]
    means = m[:t] / m[t : 2 * t] / sigma
    scale = np.abs(u).max()
    return _flags(spark, standard=abs(a / n) < 1e-6 and abs(q / n - 1) < 1e-3, transition=float(np.abs(means - (u - (u * m[t : 2 * t]).sum() / n)).max()) < 1e-3 * scale)


@query()
def lda_topics(spark, d):
    """Variational LDA over the chunks, the declared substitute for a Gibbs sampler: top terms by topic."""
    return _lda(spark, d, weighted=False)


@query()
def weighted_lda_topics(spark, d):
    """LDA with every token weighing the information of its word, minus log2 of its share of all tokens."""
    return _lda(spark, d, weighted=True)


def _lda(spark: SparkSession, d: str, weighted: bool, k: int = 10) -> DataFrame:
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer, ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    c = _chunks(spark, d).select("chunk_id", "tokens")
    cv = CountVectorizer(inputCol="tokens", outputCol="features", minDF=5).fit(c)
    x = cv.transform(c)
    if weighted:
        n = {r.token: r.tf for r in tokens.vocabulary(_chunks(spark, d), "doc_id", "tokens").join(F.broadcast(spark.createDataFrame([(w,) for w in cv.vocabulary], "token string")), "token").collect()}
        total = sum(n.values())
        scale = Vectors.dense([float(-np.log2(n[w] / total)) for w in cv.vocabulary])
        x = ElementwiseProduct(scalingVec=scale, inputCol="features", outputCol="weighed").transform(x).drop("features").withColumnRenamed("weighed", "features")
    top = LDA(k=k, maxIter=50, seed=3, docConcentration=[50.0 / k], topicConcentration=0.01).fit(x).describeTopics(10)
    words = F.array(*map(F.lit, cv.vocabulary))
    return top.select(F.col("topic"), F.transform("termIndices", lambda i: F.get(words, i)).alias("terms"))


def _tfidf(spark: SparkSession, d: str) -> Packed:
    """Kept words by document, weighted by inverse document frequency and scaled to length 1."""
    dfm = tokens.fold_rare(_chunks(spark, d), "doc_id", "tokens", 20, 10)
    df = dfm.groupBy("token").agg(F.count("*").alias("df"))
    docs = dfm.select("doc_id").distinct().agg(F.count("*").alias("n")).scalar()
    x = dfm.join(df, "token").withColumn("y", F.col("n") * (F.log((1 + docs) / (1.0 + F.col("df"))) + 1))
    size = x.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("size"))
    return Packed.of(x.join(size, "doc_id").select("doc_id", F.col("token").alias("topic"), (F.col("y") / F.col("size")).alias("y"), F.lit(0).alias("s")))


@query()
def nmf_topics(spark, d):
    """Top terms of non-negative factors of the weighted words, all of them kept."""
    p = _tfidf(spark, d)
    h, _ = fit_nmf(p, 10, rounds=400)
    rows = [(k, r + 1, p.items[i], float(h[k, i])) for k in range(len(h)) for r, i in enumerate(np.argsort(-h[k], kind="stable")[:10])]
    return spark.createDataFrame(rows, "topic int, rank int, term string, weight double")


@query(_true("falls", "positive"))
def nmf_check(spark, d):
    h, losses = fit_nmf(_tfidf(spark, d), 10, rounds=400)
    return _flags(spark, falls=_falling(losses), positive=bool((h >= 0).all() and np.isfinite(h).all()))


@query()
def word_embedding_positions(spark, d):
    """Mean word vectors of documents and their first principal component, the declared substitute for document vectors."""
    from ..operators.vectors import principal_scores

    docs = tokens.token_stream(_chunks(spark, d).withColumn("n", F.regexp_extract("chunk_id", "#s([0-9]+)$", 1).cast("bigint")), "doc_id", "n", "tokens")
    texts, counts = wordvectors.numbered_words(docs.select("doc_id", F.split("tokens", " ").alias("w")), "doc_id", "w", least=10)
    u = wordvectors.fit_vectors(texts, "w", counts, dimensions=32, window=15, rounds=15)
    return principal_scores(wordvectors.mean_vectors(texts, "doc_id", "w", u), "doc_id", "v", 32)
