"""Queries about batches, resumption, validation and cost of a classification run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as ops
from ..plans import lineage
from ..sources.tables import table
from . import query


@query()
def classification_roundtrip(spark, d):
    """All chunks in batches through the fake client, its log read back, and what is pending after half of it was lost."""
    c = table(spark, d, "campaignview_chunks_sent").where("chunk_text is not null").select("chunk_id", "chunk_text")
    m = ops.manifest(c, "chunk_id", "chunk_text")
    done = m.where(F.substring("batch_id", -1, 1).isin("0", "2", "4", "6", "8"))
    log = ops.read_log(ops.answer(done, ops.fake_client, "p"), "p")
    return ops.pending(m, log).select("batch_id", F.size("keys").alias("n"))


@query("SELECT true AS all_answered, true AS sent_once_but_for_failures, true AS nothing_left, true AS answers_fit")
def queue_roundtrip(spark, d):
    """Batches through a queue with a ledger, whose first job fails: what must hold in the end."""
    c = table(spark, d, "campaignview_chunks_sent").where("chunk_text is not null").select("chunk_id", "chunk_text")
    m = lineage.cut(ops.manifest(c, "chunk_id", "chunk_text", size=200))
    at, client = lineage.scratch(spark), ops.FakeQueue()
    queue = ops.Queue(spark, client, f"{at}/ledger", f"{at}/log", "p", job_size=50)
    sent = [queue.submit(m), queue.submit(m)]
    queue.harvest()
    sent.append(queue.submit(m))
    while queue.ledger().where("state = 'sent'").limit(1).count():
        queue.harvest()
    log = queue.log().join(m, ["batch_id", "chunk_sha256"])
    n, first = m.count(), len(client.jobs["job0"])
    fit = log.where(F.size("items") != F.size("keys")).count() == 0
    flags = (ops.pending(m, queue.log()).count() == 0, sent == [n, 0, first] and len(client.sent) == n + first, queue.submit(m) == 0, fit and log.count() == n)
    return spark.createDataFrame([flags], "all_answered boolean, sent_once_but_for_failures boolean, nothing_left boolean, answers_fit boolean")


@query("""WITH s AS (SELECT DISTINCT * FROM score_records), b AS (SELECT batch_id, count(DISTINCT chunk_id) AS chunks, count(DISTINCT chunk_id) FILTER (WHERE score IS NOT NULL) AS scored FROM s GROUP BY 1)
SELECT batch_id, chunks, scored, scored < chunks AS pending FROM b""")
def resume_pending_batches(spark, d):
    s = table(spark, d, "score_records").distinct()
    b = s.groupBy("batch_id").agg(F.count_distinct("chunk_id").alias("chunks"), F.count_distinct(F.when(F.col("score").isNotNull(), F.col("chunk_id"))).alias("scored"))
    return b.withColumn("pending", F.col("scored") < F.col("chunks"))


@query("""WITH s AS (SELECT DISTINCT chunk_id, political, score FROM score_records), e AS (SELECT DISTINCT chunk_id FROM campaignview_chunks_sent)
SELECT (SELECT count(*) FROM e WHERE chunk_id NOT IN (SELECT chunk_id FROM s WHERE chunk_id IS NOT NULL)) AS missing, (SELECT count(*) FROM s WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT chunk_id FROM e)) AS unknown,
(SELECT count(*) FROM (SELECT chunk_id FROM s GROUP BY 1 HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM s WHERE score < 0 OR score > 100) AS out_of_range, (SELECT count(*) FROM s WHERE NOT political AND score IS NOT NULL) AS scored_not_political""")
def run_validation_flags(spark, d):
    return ops.run_flags(table(spark, d, "score_records").select("chunk_id", "political", "score"), table(spark, d, "campaignview_chunks_sent"))


@query("""SELECT event_type, count(*) AS calls, round(sum((1000 * value - 200 * value) * 0.15 + 200 * value * 0.075 + 50 * value * 0.6) / 1e6, 3) AS live, round(0.5 * sum((1000 * value - 200 * value) * 0.15 + 200 * value * 0.075 + 50 * value * 0.6) / 1e6, 3) AS queued FROM events GROUP BY 1""")
def cost_projection(spark, d):
    v = F.col("value")
    price = lambda q: F.round(F.sum(ops.cost(1000 * v, 200 * v, 50 * v, 0.15, 0.075, 0.6, q)), 3)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), price(False).alias("live"), price(True).alias("queued"))


_TASKS = ["Left", "Neutral", "Right"]


@query("""WITH p AS (SELECT DISTINCT sid, text, lower(trim(stance)) AS gold FROM stratified_stance_sample WHERE stance IS NOT NULL AND text IS NOT NULL), h AS (SELECT unnest(['left', 'neutral', 'right']) AS h),
x AS (SELECT sid, gold, h, md5(sid || h) AS o FROM p, h), w AS (SELECT *, row_number() OVER (PARTITION BY sid, gold ORDER BY o, h) AS k FROM x WHERE h <> gold)
SELECT sid, h AS hypothesis, true AS entailed FROM x WHERE h = gold UNION ALL SELECT sid, h, false FROM w WHERE k = 1""")
def nli_pairs(spark, d):
    """For every coded sentence its own hypothesis and, by hash order, one wrong one."""
    p = table(spark, d, "stratified_stance_sample").where("stance is not null and text is not null").select("sid", "text", F.lower(F.trim("stance")).alias("gold")).distinct()
    h = [x.lower() for x in _TASKS]
    wrong = F.array_sort(F.transform(F.filter(F.array(*map(F.lit, h)), lambda x: x != F.col("gold")), lambda x: F.struct(F.md5(F.concat("sid", x)).alias("o"), x.alias("h"))))
    own = p.where(F.col("gold").isin(h)).select("sid", F.col("gold").alias("hypothesis"), F.lit(True).alias("entailed"))
    return own.unionByName(p.select("sid", F.get(wrong, F.lit(0))["h"].alias("hypothesis"), F.lit(False).alias("entailed")))


_TASK_PAIRS = """
WITH p AS (SELECT DISTINCT sid, text, text_en, lower(trim(stance)) AS stance, lower(trim(dimension)) AS dim FROM stratified_stance_sample WHERE stance IS NOT NULL AND dimension IS NOT NULL),
l AS (SELECT sid, 'own' AS side, stance, dim FROM p WHERE text IS NOT NULL UNION ALL SELECT sid, 'en', stance, dim FROM p WHERE text_en IS NOT NULL),
g AS (SELECT sid, side, 'stance' AS task, stance AS gold FROM l UNION ALL SELECT sid, side, 'dimension', dim FROM l UNION ALL SELECT sid, side, 'both', dim || ': ' || stance FROM l UNION ALL SELECT sid, side, 'side', CASE WHEN stance = 'neutral' THEN 'none' ELSE 'some' END FROM l),
h AS (SELECT DISTINCT task, gold AS hypothesis FROM g),
x AS (SELECT g.*, hypothesis, row_number() OVER (PARTITION BY sid, side, g.task, gold ORDER BY md5(sid || side || g.task || hypothesis), hypothesis) AS k FROM g JOIN h ON h.task = g.task AND hypothesis <> gold)
SELECT sid, side, task, gold AS hypothesis, true AS entailed FROM g UNION ALL SELECT sid, side, task, hypothesis, false FROM x WHERE k = 1"""


@query(_TASK_PAIRS)
def nli_task_pairs(spark, d):
    """Hypotheses of four tasks for every coded sentence in its own language and in English: the right one and, by hash
    order, one wrong one. Hypotheses of a task are few and travel as an array."""
    low = lambda c: F.lower(F.trim(c))
    p = table(spark, d, "stratified_stance_sample").where("stance is not null and dimension is not null").select("sid", "text", "text_en", low("stance").alias("stance"), low("dimension").alias("dim")).distinct()
    sides = F.explode(F.filter(F.array(F.struct(F.lit("own").alias("side"), F.col("text").alias("t")), F.struct(F.lit("en").alias("side"), F.col("text_en").alias("t"))), lambda x: x.t.isNotNull()))
    tasks = {"stance": F.col("stance"), "dimension": F.col("dim"), "both": F.concat("dim", F.lit(": "), "stance"), "side": F.when(F.col("stance") == "neutral", "none").otherwise("some")}
    golds = F.explode(F.array(*(F.struct(F.lit(t).alias("task"), c.alias("gold")) for t, c in tasks.items())))
    g = p.select("sid", "stance", "dim", sides.alias("x")).select("sid", F.col("x.side").alias("side"), golds.alias("g")).select("sid", "side", "g.task", "g.gold")
    h = g.groupBy("task").agg(F.collect_set("gold").alias("all"))
    ranked = F.array_sort(F.transform(F.filter("all", lambda x: x != F.col("gold")), lambda x: F.struct(F.md5(F.concat("sid", "side", "task", x)).alias("o"), x.alias("h"))))
    wrong = g.join(F.broadcast(h), "task").select("sid", "side", "task", F.get(ranked, F.lit(0))["h"].alias("hypothesis")).where("hypothesis is not null")
    return g.withColumnRenamed("gold", "hypothesis").withColumn("entailed", F.lit(True)).unionByName(wrong.withColumn("entailed", F.lit(False)))


@query("WITH x AS (SELECT event_type, count(*) AS calls, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM events GROUP BY 1) SELECT event_type, calls, round(seconds / calls, 6) AS per_call, round(seconds / calls * 1000000 / 3600, 3) AS hours_per_million FROM x")
def time_projection(spark, d):
    """Hours that a million calls take at the pace of a run's log: linear in calls."""
    t = F.col("ts").cast("timestamp").cast("double")
    x = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), (F.max(t) - F.min(t)).alias("seconds"))
    pace = F.col("seconds") / F.col("calls")
    return x.select("event_type", "calls", F.round(pace, 6).alias("per_call"), F.round(pace * 1000000 / 3600, 3).alias("hours_per_million"))
