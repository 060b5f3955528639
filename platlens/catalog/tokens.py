"""Queries about streams, vocabularies, collocations and class terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tokens as ops
from ..sources.tables import table
from . import query

_TOK = "regexp_extract_all(lower({0}), '[a-zà-ÿ][a-zà-ÿ]+')"
_STOP = ["the", "and", "of", "to", "in"]


def _chunks(spark, d):
    """Every chunk with a text once, with its tokens; whether it has a topic doesn't matter."""
    c = table(spark, d, "campaignview_chunks_sent").where("chunk_text is not null").select("chunk_id", "doc_id", "chunk_text").distinct()
    return c.withColumn("tokens", ops.tokenise(F.col("chunk_text"), _STOP))


def _topics(spark, d):
    return table(spark, d, "chunk_topics").select("chunk_id", "topic").distinct()


_C = f"c AS (SELECT *, list_filter({_TOK.format('chunk_text')}, lambda w: w NOT IN ('the', 'and', 'of', 'to', 'in')) AS tokens FROM (SELECT DISTINCT chunk_id, doc_id, chunk_text FROM campaignview_chunks_sent WHERE chunk_text IS NOT NULL))"
_N = f"{_C}, x AS (SELECT doc_id, unnest(tokens) AS token FROM c)"


@query(f"WITH {_C} SELECT doc_id, string_agg(array_to_string(tokens, ' '), ' eos ' ORDER BY CAST(regexp_extract(chunk_id, '#s([0-9]+)$', 1) AS BIGINT)) AS tokens FROM c WHERE len(tokens) > 0 GROUP BY doc_id")
def token_stream(spark, d):
    c = _chunks(spark, d).withColumn("n", F.regexp_extract("chunk_id", "#s([0-9]+)$", 1).cast("bigint"))
    return ops.token_stream(c, "doc_id", "n", "tokens")


@query(f"WITH {_N} SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM x GROUP BY token")
def vocab_sizes(spark, d):
    return ops.vocabulary(_chunks(spark, d), "doc_id", "tokens")


@query("SELECT acronym, count(*) AS n FROM (SELECT unnest(regexp_extract_all(chunk_text, '[\\p{L}\\p{N}_]+')) AS acronym FROM (SELECT DISTINCT chunk_id, chunk_text FROM br_manifestos_chunks_sent)) WHERE regexp_full_match(acronym, '[A-Z]{2,6}') GROUP BY 1")
def acronym_harvest(spark, d):
    c = table(spark, d, "br_manifestos_chunks_sent").select("chunk_id", "chunk_text").distinct()
    words = c.select(F.explode(F.regexp_extract_all("chunk_text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("acronym"))
    return words.where(F.col("acronym").rlike("^[A-Z]{2,6}$")).groupBy("acronym").agg(F.count("*").alias("n"))


_K = f"{_N}, n AS (SELECT doc_id, token, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT token, sum(n) >= 20 AND count(*) >= 10 AS ok, sum(n) AS tf FROM n GROUP BY 1)"


@query(f"WITH {_K} SELECT doc_id, CASE WHEN ok THEN token ELSE '__oov__' END AS token, CAST(sum(n) AS BIGINT) AS n FROM n JOIN k USING (token) GROUP BY ALL")
def oov_fold(spark, d):
    return ops.fold_rare(_chunks(spark, d), "doc_id", "tokens", 20, 10)


@query(f"WITH {_K}, t AS (SELECT token FROM k ORDER BY tf DESC, token LIMIT 200) SELECT n.doc_id, CASE WHEN t.token IS NOT NULL THEN t.token ELSE '__oov__' END AS token, CAST(sum(n) AS BIGINT) AS n FROM n LEFT JOIN t ON t.token = n.token GROUP BY ALL")
def fold_to_target(spark, d):
    return ops.fold_to_target(ops.fold_rare(_chunks(spark, d), "doc_id", "tokens", 1, 1), "doc_id", 200)


@query(f"WITH {_K} SELECT doc_id, token, least(n, 3) AS n FROM n WHERE n > 1")
def winsor_counts(spark, d):
    return ops.fold_rare(_chunks(spark, d), "doc_id", "tokens", 1, 1).where("n > 1").withColumn("n", F.least("n", F.lit(3).cast("bigint")))


_B = f"{_C}, b AS (SELECT tokens[i] AS a, tokens[i + 1] AS b FROM (SELECT tokens, unnest(range(1, len(tokens))) AS i FROM c WHERE len(tokens) > 1)), n AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY ALL)"


@query(f"""WITH {_B}, l AS (SELECT a, sum(n) AS na FROM n GROUP BY 1), r AS (SELECT b, sum(n) AS nb FROM n GROUP BY 1), t AS (SELECT sum(n) AS t FROM n),
s AS (SELECT a || '_' || b AS bigram, CAST(n AS BIGINT) AS n, round(ln(n * t / (na * nb)) / -ln(n / t), 6) AS npmi FROM n JOIN l USING (a) JOIN r USING (b), t WHERE n >= 10), f AS (SELECT * FROM s WHERE npmi >= 0.4)
SELECT * FROM f WHERE npmi >= (SELECT min(npmi) FROM (SELECT npmi FROM f ORDER BY npmi DESC LIMIT 100))""")
def bigram_npmi(spark, d):
    return ops.collocations(_chunks(spark, d), "tokens", least=10, floor=0.4, target=100)


@query()
def glued_stream(spark, d):
    """Chunks with the collocations glued; greedy, so without an SQL twin."""
    c = _chunks(spark, d)
    return ops.glued(c.select("chunk_id", "tokens"), "tokens", ops.collocations(c, "tokens", least=10, floor=0.4, target=100)).select("chunk_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"""WITH {_K}, s AS (SELECT token, tf, CASE WHEN length(token) >= 5 AND regexp_matches(token, '(es|os|as)$') THEN token[:-3] WHEN length(token) >= 4 AND regexp_matches(token, '[soa]$') THEN token[:-2] ELSE token END AS stem FROM k)
SELECT stem, arg_max(token, (tf, token)) AS label, CAST(sum(tf) AS BIGINT) AS tf FROM s GROUP BY stem""")
def stem_labels(spark, d):
    return ops.stem_labels(ops.vocabulary(_chunks(spark, d), "doc_id", "tokens"), ops.suffix_stem(F.col("token")))


@query(f"SELECT chunk_id, array_to_string(list_filter({_TOK.format('chunk_text')}, lambda w: w NOT IN ('the', 'de')), ' ') AS tokens FROM (SELECT DISTINCT chunk_id, chunk_text FROM br_manifestos_chunks_sent WHERE chunk_text IS NOT NULL)")
def negations_kept(spark, d):
    """Tokens without stop words, but with the negations among them."""
    c = table(spark, d, "br_manifestos_chunks_sent").where("chunk_text is not null").select("chunk_id", "chunk_text").distinct()
    return c.select("chunk_id", F.array_join(ops.tokenise(F.col("chunk_text"), ["the", "de", "sem", "não"]), " ").alias("tokens"))


def _terms(spark, d):
    c = _chunks(spark, d).join(_topics(spark, d).where("topic >= 0"), "chunk_id")
    return c.select("topic", F.explode("tokens").alias("token")).groupBy("topic", "token").agg(F.count("*").alias("n"))


_T = f"{_N}, xt AS (SELECT topic, unnest(tokens) AS token FROM c JOIN (SELECT DISTINCT chunk_id, topic FROM chunk_topics) USING (chunk_id)), n AS (SELECT topic, token, CAST(count(*) AS DOUBLE) AS n FROM xt WHERE topic >= 0 GROUP BY ALL), z AS (SELECT topic, sum(n) AS size FROM n GROUP BY 1)"
_CLASS_DF = f"{_T}, q AS (SELECT token, count(*) AS df, sum(n) AS tf FROM n GROUP BY 1), s AS (SELECT n.topic, n.token, round(n / size * ln(1 / (CAST(df AS DOUBLE) / (SELECT count(*) FROM z) + 1e-6)), 8) AS score FROM n JOIN z USING (topic) JOIN q ON q.token = n.token), k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, token) AS rank FROM s)"


@query(f"WITH {_CLASS_DF} SELECT * FROM k WHERE rank <= 10")
def ctfidf_class_df(spark, d):
    return ops.class_tfidf(_terms(spark, d))


@query(f"WITH {_T}, q AS (SELECT token, sum(n) AS tf FROM n GROUP BY 1), s AS (SELECT n.topic, n.token, round(n / size * ln(1 + (SELECT avg(size) FROM z) / tf), 8) AS score FROM n JOIN z USING (topic) JOIN q ON q.token = n.token), k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, token) AS rank FROM s) SELECT * FROM k WHERE rank <= 10")
def ctfidf_avg_count(spark, d):
    return ops.class_tfidf_average(_terms(spark, d))


@query(f"WITH {_CLASS_DF}, w AS (SELECT topic, token FROM k WHERE rank <= 10), h AS (SELECT token, count(DISTINCT doc_id) AS docs FROM x GROUP BY 1) SELECT topic, CAST(median(coalesce(docs, 0)) AS DOUBLE) AS spread FROM w LEFT JOIN h USING (token) GROUP BY topic")
def keyword_spread(spark, d):
    return ops.keyword_spread(_chunks(spark, d), "doc_id", "tokens", ops.class_tfidf(_terms(spark, d)))


@query(f"WITH {_CLASS_DF} SELECT round(CAST(count(DISTINCT token) AS DOUBLE) / count(*), 6) AS diversity FROM k WHERE rank <= 10")
def topic_diversity(spark, d):
    return ops.topic_diversity(ops.class_tfidf(_terms(spark, d)))


@query(f"""WITH {_CLASS_DF}, w AS (SELECT topic, token FROM k WHERE rank <= 5), h AS (SELECT DISTINCT doc_id, token FROM x WHERE token IN (SELECT token FROM w)), o AS (SELECT token, CAST(count(*) AS DOUBLE) AS n FROM h GROUP BY 1), t AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS t FROM c),
p AS (SELECT u.topic, u.token AS a, v.token AS b FROM w u JOIN w v ON u.topic = v.topic AND u.token < v.token), j AS (SELECT a.token AS a, b.token AS b, CAST(count(*) AS DOUBLE) AS n FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.token < b.token GROUP BY ALL)
SELECT topic, round(avg(CASE WHEN j.n IS NULL THEN -1 WHEN j.n = t THEN 1 ELSE ln(j.n * t / (oa.n * ob.n)) / -ln(j.n / t) END), 6) AS npmi FROM p LEFT JOIN j ON j.a = p.a AND j.b = p.b JOIN o oa ON oa.token = p.a JOIN o ob ON ob.token = p.b, t GROUP BY topic""")
def topic_npmi(spark, d):
    return ops.topic_coherence(_chunks(spark, d), "doc_id", "tokens", ops.class_tfidf(_terms(spark, d), k=5))


@query(f"WITH {_CLASS_DF} SELECT topic, round(CAST(sum(n) FILTER (WHERE token IN (SELECT token FROM k WHERE rank <= 10)) AS DOUBLE) / sum(n), 6) AS coverage FROM n GROUP BY topic")
def dictionary_coverage(spark, d):
    t = _terms(spark, d)
    words = ops.class_tfidf(t).select("token").distinct().withColumn("hit", F.lit(True))
    return t.join(F.broadcast(words), "token", "left").groupBy("topic").agg(F.round(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).cast("double") / F.sum("n"), 6).alias("coverage"))


_AFTER = f"{_CLASS_DF}, new AS (SELECT topic, token, rank FROM k WHERE rank <= 5)"


@query(f"""WITH {_AFTER}, o AS (SELECT DISTINCT chunk_id, topic_orig FROM chunk_topics), xo AS (SELECT o.topic_orig AS topic, unnest(c.tokens) AS token FROM c JOIN o USING (chunk_id) WHERE o.topic_orig >= 0),
no AS (SELECT topic, token, CAST(count(*) AS DOUBLE) AS n FROM xo GROUP BY ALL), zo AS (SELECT topic, sum(n) AS size FROM no GROUP BY 1), qo AS (SELECT token, count(*) AS df FROM no GROUP BY 1),
so AS (SELECT no.topic, no.token, round(n / size * ln(1 / (CAST(df AS DOUBLE) / (SELECT count(*) FROM zo) + 1e-6)), 8) AS score FROM no JOIN zo USING (topic) JOIN qo ON qo.token = no.token),
ko AS (SELECT topic, token, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, token) AS rank FROM so) WHERE rank <= 5)
SELECT coalesce(a.topic, b.topic) AS topic, coalesce(a.token, b.token) AS token, b.rank AS rank_before, a.rank AS rank_after FROM new a FULL JOIN ko b ON a.topic = b.topic AND a.token = b.token""")
def keywords_before_after(spark, d):
    """Top terms of topics as first assigned and as they are now, side by side."""
    c = _chunks(spark, d)
    first = table(spark, d, "chunk_topics").select("chunk_id", F.col("topic_orig").alias("first")).distinct()
    terms = lambda x, t: x.where(F.col(t) >= 0).select(F.col(t).alias("topic"), F.explode("tokens").alias("token")).groupBy("topic", "token").agg(F.count("*").alias("n"))
    after = ops.class_tfidf(terms(c.join(_topics(spark, d), "chunk_id"), "topic"), k=5).select("topic", "token", F.col("rank").alias("rank_after"))
    before = ops.class_tfidf(terms(c.join(first, "chunk_id"), "first"), k=5).select("topic", "token", F.col("rank").alias("rank_before"))
    return after.join(before, ["topic", "token"], "full").select("topic", "token", "rank_before", "rank_after")
