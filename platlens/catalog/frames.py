"""Queries behind tables and figures of a report."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import embedding
from ..operators import frames as ops
from ..operators import metrics as metric_ops
from ..operators import tokens as token_ops
from ..operators.relational import dedup
from ..plans.lineage import scratch
from ..sources.tables import table
from . import query
from .base import CELLS, us_chunks
from .cells import cells_of
from .tokens import _CLASS_DF, _chunks, _terms

_SCORES = "(SELECT doc_id, avg(score) AS m FROM (SELECT DISTINCT chunk_id, doc_id, political, score FROM score_records) WHERE political AND score BETWEEN 0 AND 100 GROUP BY 1)"
_DOCS = f"docs AS (SELECT s.doc_id, m, party FROM {_SCORES} s LEFT JOIN (SELECT doc_id, min(upper(trim(party_label))) AS party FROM campaignview_chunks_sent GROUP BY 1) USING (doc_id))"
# Expert scores of parties, from 0 to 10: the mean share of right codes of a party's sentences.
_EXPERT = "expert AS (SELECT upper(trim(party)) AS party, 10 * avg(CASE lower(trim(stance)) WHEN 'right' THEN 1.0 ELSE 0.0 END) AS ext FROM (SELECT DISTINCT sid, party, stance FROM stratified_stance_sample) WHERE party IS NOT NULL AND stance IS NOT NULL GROUP BY 1)"


def _scored(spark, d):
    s = table(spark, d, "score_records").select("chunk_id", "doc_id", "political", "score").distinct().where("political and score between 0 and 100").groupBy("doc_id").agg(F.avg("score").alias("m"))
    p = table(spark, d, "campaignview_chunks_sent").groupBy("doc_id").agg(F.min(F.upper(F.trim("party_label"))).alias("party"))
    return s.join(p, "doc_id", "left")


def _experts(spark, d):
    s = table(spark, d, "stratified_stance_sample").select("sid", "party", "stance").distinct().where("party is not null and stance is not null")
    right = F.when(F.lower(F.trim("stance")) == "right", 1.0).otherwise(0.0)
    return s.groupBy(F.upper(F.trim("party")).alias("party")).agg((10 * F.avg(right)).alias("ext"))


@query(f"WITH {_EXPERT}, p AS (SELECT DISTINCT sid, upper(trim(party)) AS party FROM stratified_stance_sample) SELECT sid, p.party, round(ext, 6) AS ext, CASE WHEN p.party IS NULL OR ext IS NULL THEN 'none' WHEN ext <= 4.77 THEN 'left' ELSE 'right' END AS bloc FROM p LEFT JOIN expert USING (party)")
def party_scores_join(spark, d):
    """Sentences with the expert score of their party, names compared in capitals, and the bloc it makes."""
    p = table(spark, d, "stratified_stance_sample").select("sid", F.upper(F.trim("party")).alias("party")).distinct()
    j = p.join(_experts(spark, d), "party", "left")
    return j.select("sid", "party", F.round("ext", 6).alias("ext"), ops.bloc(F.col("party"), F.col("ext")).alias("bloc"))


@query("""WITH m AS (SELECT lower(trim(dimension)) AS dim, lower(trim(stance)) AS stance, min(target_permille) AS permille FROM stance_targets GROUP BY ALL), g AS (SELECT countryname, min(country_group) AS region FROM stratified_stance_sample WHERE countryname IS NOT NULL GROUP BY 1)
SELECT s.sid, m.permille, g.region FROM (SELECT DISTINCT sid, lower(trim(dimension)) AS dim, lower(trim(stance)) AS stance, countryname FROM stratified_stance_sample) s LEFT JOIN m USING (dim, stance) LEFT JOIN g USING (countryname)""")
def mapped_countries(spark, d):
    """Sentences with what their code maps to and the group of their country: two left joins with small tables."""
    low = lambda c: F.lower(F.trim(c))
    m = table(spark, d, "stance_targets").groupBy(low("dimension").alias("dim"), low("stance").alias("stance")).agg(F.min("target_permille").alias("permille"))
    s = table(spark, d, "stratified_stance_sample")
    g = s.where("countryname is not null").groupBy("countryname").agg(F.min("country_group").alias("region"))
    rows = s.select("sid", low("dimension").alias("dim"), low("stance").alias("stance"), "countryname").distinct()
    return rows.join(F.broadcast(m), ["dim", "stance"], "left").join(g, "countryname", "left").select("sid", "permille", "region")


@query("SELECT doc_id, label, source FROM documents JOIN embeddings ON vec_id = doc_id % 100")
def embedding_alignment(spark, d):
    """Documents beside their vectors; a document without one is an error, not a lost row."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 100).alias("vec_id"))
    return ops.assert_covered(docs, e, "vec_id", "documents").join(e, "vec_id").select("doc_id", "label", "source")


@query(f"WITH {_CLASS_DF}, w AS (SELECT topic, token FROM k WHERE rank <= 10), h AS (SELECT token, count(DISTINCT doc_id) AS docs FROM x GROUP BY 1), sp AS (SELECT topic, CAST(median(coalesce(docs, 0)) AS DOUBLE) AS spread FROM w LEFT JOIN h USING (token) GROUP BY topic), i AS (SELECT topic, count(*) AS chunks FROM (SELECT DISTINCT chunk_id, topic FROM chunk_topics) GROUP BY 1) SELECT i.topic, chunks, spread FROM i LEFT JOIN sp ON sp.topic = i.topic")
def topic_info_spread(spark, d):
    i = table(spark, d, "chunk_topics").select("chunk_id", "topic").distinct().groupBy("topic").agg(F.count("*").alias("chunks"))
    return i.join(token_ops.keyword_spread(_chunks(spark, d), "doc_id", "tokens", token_ops.class_tfidf(_terms(spark, d))), "topic", "left")


@query(f"WITH {_CLASS_DF}, v AS (SELECT token, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1), m AS (SELECT token, min(topic) AS topic FROM k WHERE rank = 1 GROUP BY 1) SELECT v.token, n, coalesce('t' || CAST(m.topic AS VARCHAR), v.token) AS label FROM v LEFT JOIN m USING (token)")
def labelled_features(spark, d):
    """Terms with the label a map gives them, else their own name."""
    t = _terms(spark, d)
    v = t.groupBy("token").agg(F.sum("n").alias("n"))
    m = token_ops.class_tfidf(t, k=1).groupBy("token").agg(F.min("topic").alias("topic"))
    return v.join(m, "token", "left").select("token", "n", F.coalesce(F.concat(F.lit("t"), F.col("topic").cast("string")), "token").alias("label"))


@query("SELECT count(*) AS groups, max(n) AS largest, min(n) AS smallest, round(CAST(max(n) AS DOUBLE) / min(n), 6) AS ratio FROM (SELECT lower(trim(dimension)) AS g, count(*) AS n FROM stratified_stance_sample GROUP BY 1)")
def group_imbalance(spark, d):
    return ops.imbalance(table(spark, d, "stratified_stance_sample").withColumn("g", F.lower(F.trim("dimension"))), "g")


@query("WITH x AS (SELECT c_acctbal / 1000 AS x FROM customer WHERE c_acctbal IS NOT NULL), m AS (SELECT count(*) AS n, avg(x) AS a, avg(x ** 2) AS b, avg(x ** 3) AS c, avg(x ** 4) AS d FROM x) SELECT n, round(sqrt(greatest(d - b * b - (c - a * b) ** 2 / (b - a * a), 0)), 5) AS sd FROM m")
def standard_curvature(spark, d):
    x = table(spark, d, "customer").select((F.col("c_acctbal") / 1000).alias("x"))
    return ops.residual_sd_of_square(x, "x").withColumn("sd", F.round("sd", 5))


@query(f"WITH {_DOCS}, g AS (SELECT party, count(*) AS n, avg(m) AS m, var_pop(m) AS s FROM docs WHERE party IS NOT NULL GROUP BY 1) SELECT round(sqrt(sum(n * s) / sum(n)), 6) AS within, round(sqrt(greatest(sum(n * m * m) / sum(n) - (sum(n * m) / sum(n)) ** 2, 0)), 6) AS between FROM g")
def within_between_parties(spark, d):
    return ops.within_between(_scored(spark, d), "party", "m")


@query("SELECT * FROM (SELECT c_custkey, c_acctbal, 'low' AS \"end\", row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer WHERE c_acctbal IS NOT NULL) WHERE place <= 3 UNION ALL SELECT * FROM (SELECT c_custkey, c_acctbal, 'high', row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_acctbal IS NOT NULL) WHERE place <= 3")
def notable_documents(spark, d):
    return ops.notable(table(spark, d, "customer"), "c_custkey", "c_acctbal")


_R = "CASE WHEN count(*) FILTER (WHERE {0} IS NOT NULL AND {1} IS NOT NULL) >= 3 THEN round((avg({0} * {1}) - avg({0}) * avg({1})) / nullif(stddev_pop({0}) * stddev_pop({1}), 0), 6) END"


@query("WITH x AS (SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS p, CAST(l_discount AS DOUBLE) AS c FROM lineitem) " + " UNION ALL ".join(f"SELECT '{n}' AS a, '{m}' AS b, count(*) AS n, {_R.format(a, b)} AS r FROM x" for n, a, m, b in (("l_quantity", "q", "l_extendedprice", "p"), ("l_quantity", "q", "l_discount", "c"), ("l_extendedprice", "p", "l_discount", "c"))))
def agreement_matrix(spark, d):
    return ops.agreement_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(CELLS + """, p AS (SELECT doc_id, min(party_label) AS party FROM us GROUP BY 1), c AS (SELECT cells.*, party FROM cells JOIN p USING (doc_id)),
k AS (SELECT topic, sum(CASE WHEN party = 'Democratic' THEN y ELSE 0 END) AS ya, sum(CASE WHEN party = 'Republican' THEN y ELSE 0 END) AS yb, sum(CASE WHEN party = 'Democratic' THEN s ELSE 0 END) AS sa, sum(CASE WHEN party = 'Republican' THEN s ELSE 0 END) AS sb FROM c GROUP BY 1)
SELECT topic, round(ya / (SELECT sum(ya) FROM k) - yb / (SELECT sum(yb) FROM k), 6) AS salience_gap, round(sa / nullif(ya, 0) - sb / nullif(yb, 0), 6) AS stance_gap FROM k""")
def salience_gap(spark, d):
    p = us_chunks(spark, d).groupBy("doc_id").agg(F.min("party_label").alias("party"))
    return ops.salience_gap(cells_of(spark, d).join(p, "doc_id"), "party", "Democratic", "Republican")


@query(CELLS + f""", t AS (SELECT topic, sum(s) / CAST(sum(y) AS DOUBLE) AS alpha, 0.25 * (topic % 3 - 1) AS beta FROM cells GROUP BY topic), {_DOCS}, g AS (SELECT party, avg(m / 50 - 1) AS m FROM docs GROUP BY 1)
SELECT topic, party, round(least(greatest(alpha + beta * g.m, -1), 1), 6) AS expected FROM t, g""")
def expected_stance(spark, d):
    """Stance that topic lines expect at the mean position of each party."""
    c = cells_of(spark, d).groupBy("topic").agg((F.sum("s").cast("double") / F.sum("y")).alias("alpha")).withColumn("beta", 0.25 * (F.col("topic") % 3 - 1))
    return ops.expected_stance(c, _scored(spark, d).withColumn("theta", F.col("m") / 50 - 1), "party")


@query(CELLS + ", m AS (SELECT topic, CAST(floor(topic / 4.0) AS INTEGER) AS code FROM cells GROUP BY 1), k AS (SELECT code, count(DISTINCT topic) AS topics, CAST(sum(y) AS BIGINT) AS chunks, string_agg(DISTINCT CAST(topic AS VARCHAR), ', ' ORDER BY CAST(topic AS VARCHAR)) AS members FROM cells JOIN m USING (topic) GROUP BY 1) SELECT * FROM k")
def crosswalk_table(spark, d):
    """Classes of a crosswalk with their topics and chunks."""
    c = cells_of(spark, d).withColumn("code", F.floor(F.col("topic") / 4).cast("int"))
    names = F.array_join(F.array_sort(F.collect_set(F.col("topic").cast("string"))), ", ")
    return c.groupBy("code").agg(F.count_distinct("topic").alias("topics"), F.sum("y").alias("chunks"), names.alias("members"))


@query(CELLS + """, f AS (SELECT doc_id, sum(s) / CAST(sum(y) AS DOUBLE) AS fine FROM cells GROUP BY 1), z AS (SELECT doc_id, CAST(floor(topic / 4.0) AS INTEGER) AS code, sum(s) / CAST(sum(y) AS DOUBLE) AS m FROM cells GROUP BY ALL), g AS (SELECT doc_id, avg(m) AS macro FROM z GROUP BY 1)
SELECT count(*) AS docs, round((avg(fine * macro) - avg(fine) * avg(macro)) / nullif(stddev_pop(fine) * stddev_pop(macro), 0), 6) AS r FROM f JOIN g USING (doc_id)""")
def macro_against_fine(spark, d):
    """How a document's mean stance over topics agrees with that over classes."""
    c = cells_of(spark, d)
    mean = F.sum("s").cast("double") / F.sum("y")
    fine = c.groupBy("doc_id").agg(mean.alias("fine"))
    macro = c.groupBy("doc_id", F.floor(F.col("topic") / 4).alias("code")).agg(mean.alias("m")).groupBy("doc_id").agg(F.avg("m").alias("macro"))
    return fine.join(macro, "doc_id").agg(F.count("*").alias("docs"), F.round(ops.pearson("fine", "macro"), 6).alias("r"))


@query("SELECT count(*) FILTER (WHERE t.chunk_id IS NULL) AS without_topic, count(*) AS chunks FROM (SELECT DISTINCT chunk_id FROM campaignview_chunks_sent) c LEFT JOIN (SELECT DISTINCT chunk_id FROM chunk_topics) t USING (chunk_id)")
def topic_coverage(spark, d):
    """Chunks that no topic row covers: what assert_covered refuses."""
    c = table(spark, d, "campaignview_chunks_sent").select("chunk_id").distinct()
    t = table(spark, d, "chunk_topics").select("chunk_id").distinct().withColumn("hit", F.lit(True))
    j = c.join(t, "chunk_id", "left")
    return j.agg(F.count_if(F.col("hit").isNull()).alias("without_topic"), F.count("*").alias("chunks"))


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY n_words DESC, text) AS k FROM (SELECT DISTINCT sid, manifesto_id, cmp_code, language, n_words, text FROM stratified_stance_sample WHERE sid IS NOT NULL))
SELECT sid, manifesto_id, language, n_words FROM s WHERE k = 1 AND n_words >= 8 AND regexp_matches(text, '[.!?;:…]["'')”’\\]]?$') AND NOT regexp_matches(ltrim(text), '^\\p{Ll}') AND cmp_code IS NOT NULL""")
def sentence_pool(spark, d):
    """Full sentences with a code, one row each: eight words or more, an end, and no small letter at the beginning."""
    s = table(spark, d, "stratified_stance_sample").where("sid is not null").select("sid", "manifesto_id", "cmp_code", "language", "n_words", "text").distinct()
    s = dedup(s.withColumn("least", F.negative("n_words")), ["sid"], ["least", "text"], "first")
    ends, begins = F.col("text").rlike(r"""[.!?;:…]["')”’\]]?$"""), ~F.ltrim("text").rlike(r"^\p{Ll}")
    return s.where((F.col("n_words") >= 8) & ends & begins & F.col("cmp_code").isNotNull()).select("sid", "manifesto_id", "language", "n_words")


@query(f"""WITH c AS (SELECT sid, language, lower(trim(stance)) AS gold, lower(trim(gpt_stance)) AS pred FROM (SELECT DISTINCT * FROM stratified_stance_sample)), k AS (SELECT language, gold, count(*) AS n, count(*) FILTER (WHERE gold = pred) AS hit FROM c WHERE gold IS NOT NULL AND pred IS NOT NULL AND language IS NOT NULL GROUP BY ALL)
SELECT language, CAST(sum(n) AS BIGINT) AS n, round(avg(hit / n), 6) AS balanced_accuracy FROM k GROUP BY 1""")
def balanced_accuracy_by_language(spark, d):
    low = lambda c: F.lower(F.trim(c))
    c = table(spark, d, "stratified_stance_sample").distinct().select("language", low("stance").alias("gold"), low("gpt_stance").alias("pred")).where("gold is not null and pred is not null and language is not null")
    k = c.groupBy("language", "gold").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("hit"))
    return k.groupBy("language").agg(F.sum("n").alias("n"), F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("balanced_accuracy"))


@query("SELECT doc_id, 64 AS size, 1.0 AS norm FROM documents WHERE trim(text) <> ''")
def embedding_stage(spark, d):
    """Documents encoded in resumable blocks (by the hashing encoder): sizes and lengths of the vectors read back."""
    at = scratch(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    embedding.embed_in_blocks(docs.where("doc_id % 2 = 0"), "doc_id", "text", f"{at}/half", blocks=2)
    v = embedding.embed_in_blocks(docs, "doc_id", "text", f"{at}/all", blocks=4)
    norm = F.sqrt(F.aggregate(F.transform("vector", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    return v.select("doc_id", F.size("vector").alias("size"), F.round(norm, 4).alias("norm"))


@query(f"""WITH {_CLASS_DF}, w AS (SELECT topic, list(token ORDER BY rank) AS w FROM k WHERE rank <= 10 GROUP BY 1), f AS (SELECT *, row_number() OVER (PARTITION BY w[1] ORDER BY topic) AS c FROM w)
SELECT topic, CASE WHEN c = 1 THEN w[1] ELSE w[1] || ' ' || w[2] END AS name, sha256(array_to_string(w, chr(31))) AS source FROM f""")
def topic_names(spark, d):
    """Topics named by their best term; those that collide with an earlier one get their next term as well."""
    k = embedding.keyword_arrays(token_ops.class_tfidf(_terms(spark, d)))
    named = embedding.name_topics(k, lambda t, words, taken: words[0])
    return spark.createDataFrame(named, "topic int, name string, source string")


@query()
def guided_keywords(spark, d):
    """Terms whose hashed vectors are nearest to their topic's."""
    t = _terms(spark, d)
    v = embedding.embed(t.select("token").distinct(), "token", "token")
    return embedding.guided_keywords(t, v)


@query(f"WITH c AS (SELECT sid, lower(trim(stance)) AS g, CAST(n_words AS DOUBLE) AS s FROM (SELECT DISTINCT * FROM stratified_stance_sample) WHERE stance IS NOT NULL AND n_words IS NOT NULL), r AS (SELECT g, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM c), a AS (SELECT g, count(*) AS m, sum(r) AS r FROM r GROUP BY 1), n AS (SELECT count(*) AS n FROM c), x AS (SELECT m, (r - m * (m + 1) / 2.0) / nullif(CAST(m AS DOUBLE) * (n - m), 0) AS auc FROM a, n) SELECT round(avg(auc), 5) AS macro, round(sum(m * auc) / sum(m), 5) AS weighted FROM x")
def auc_summary(spark, d):
    """Mean of the one-against-rest AUCs, plain and weighted by class size."""
    c = table(spark, d, "stratified_stance_sample").distinct().where("stance is not null and n_words is not null").select(F.lower(F.trim("stance")).alias("g"), F.col("n_words").cast("double").alias("s"))
    a = metric_ops.auc(c, "g", "s")
    m = F.col("positives").cast("double")
    return a.agg(F.round(F.avg("auc"), 5).alias("macro"), F.round(F.sum(m * F.col("auc")) / F.sum(m), 5).alias("weighted"))


@query(CELLS + """, p AS (SELECT doc_id, min(party_label) AS party FROM us GROUP BY 1), c AS (SELECT cells.*, party FROM cells JOIN p USING (doc_id)),
k AS (SELECT topic, CAST(sum(CASE WHEN party = 'Democratic' THEN y ELSE 0 END) AS DOUBLE) AS ya, CAST(sum(CASE WHEN party = 'Republican' THEN y ELSE 0 END) AS DOUBLE) AS yb, sum(CASE WHEN party = 'Democratic' THEN s ELSE 0 END) AS sa, sum(CASE WHEN party = 'Republican' THEN s ELSE 0 END) AS sb FROM c GROUP BY 1),
r AS (SELECT *, rank() OVER (ORDER BY ya) + (count(*) OVER (PARTITION BY ya) - 1) / 2.0 AS ra, rank() OVER (ORDER BY yb) + (count(*) OVER (PARTITION BY yb) - 1) / 2.0 AS rb, row_number() OVER (ORDER BY ya DESC, topic) AS pa FROM k)
SELECT round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) AS rho, CAST(count(*) FILTER (WHERE sa * sb < 0) AS BIGINT) AS sign_flips, round(sum(ya) FILTER (WHERE pa <= 5) / sum(ya), 6) AS top_a, round(sum(yb) FILTER (WHERE pa <= 5) / sum(yb), 6) AS same_topics_b FROM r""")
def agenda_summary(spark, d):
    """How alike two groups' agendas are: rank correlation of topics, topics with opposite stance, and what share of either's
    chunks the five largest topics of the first have."""
    p = us_chunks(spark, d).groupBy("doc_id").agg(F.min("party_label").alias("party"))
    c = cells_of(spark, d).join(p, "doc_id")
    side = lambda g, v: F.sum(F.when(F.col("party") == g, F.col(v)).otherwise(0))
    k = c.groupBy("topic").agg(side("Democratic", "y").cast("double").alias("ya"), side("Republican", "y").cast("double").alias("yb"), side("Democratic", "s").alias("sa"), side("Republican", "s").alias("sb"))
    r = metric_ops.average_rank(metric_ops.average_rank(k, "ya", "ra"), "yb", "rb").withColumn("pa", F.row_number().over(Window.orderBy(F.desc("ya"), "topic")))  # one row a topic
    top = lambda v: F.round(F.sum(F.when(F.col("pa") <= 5, F.col(v))) / F.sum(v), 6)
    return r.agg(F.round(metric_ops.pearson("ra", "rb"), 6).alias("rho"), F.count_if(F.col("sa") * F.col("sb") < 0).alias("sign_flips"), top("ya").alias("top_a"), top("yb").alias("same_topics_b"))
