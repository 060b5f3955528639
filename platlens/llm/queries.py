"""The queries of this package, each over its whole tables, and what DuckDB can say of the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .distinct_terms import term_distinctiveness, top_terms
from .frequency import term_frequencies
from .leakage import leak_report, leaked_passages
from .mixing import TOKENIZER, SourceMix
from .neardup import NearDuplicates, pieces_of
from .quality import text_quality
from .quota_sample import TargetSample
from .scan_repair import fit, repaired
from .sentences import fit_on, sentence_ends, sentences
from .site_lines import SiteLines

US, BR = "campaignview_chunks_sent", "br_manifestos_chunks_sent"


def _both_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, US).select("chunk_id", "chunk_text").unionByName(table(spark, d, BR).select("chunk_id", "chunk_text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(table(spark, d, "wf_tokens")).where("mark is not null").select("term", "mark")


def p1_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(table(spark, d, "wf_tokens")).select("term", "tf", "df", "docs", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = _both_chunks(spark, d)
    model = fit_on(chunks)
    plain = chunks.where(F.col("chunk_text").isNotNull() & ~F.col("chunk_text").contains("\n"))
    return sentence_ends(plain, model, ["chunk_id"]).distinct().select("chunk_id", F.explode("ends").alias("end_char"))


def p2_sentences(spark: SparkSession, d: str) -> DataFrame:
    chunks = _both_chunks(spark, d)
    return sentences(chunks.distinct(), fit_on(chunks))


def p2_text_ends(spark: SparkSession, d: str) -> DataFrame:
    """Per text how far its sentences reach, whether their ends rise, and whether any ends in white space."""
    chunks = _both_chunks(spark, d)
    plain = chunks.where(F.col("chunk_text").isNotNull() & ~F.col("chunk_text").contains("\n"))
    e = sentence_ends(plain.distinct(), fit_on(chunks), ["chunk_id", "chunk_text"])
    rise = F.forall(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.get("ends", i) > F.get("ends", i - 1))
    blank = F.exists("ends", lambda x: F.substring(F.col("chunk_text"), x.cast("int"), F.lit(1)).rlike(r"^[\s\p{Z}]$"))
    some = e.where(F.size("ends") > 0)
    return some.select("chunk_id", F.element_at("ends", -1).alias("reach"), F.when(F.size("ends") > 1, rise).otherwise(True).alias("rising"), blank.alias("blank_end")).distinct()


def _near(spark: SparkSession, d: str) -> NearDuplicates:
    return NearDuplicates(pieces_of(table(spark, d, US), "us").unionByName(pieces_of(table(spark, d, BR), "br")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).classes()


def _sample(spark: SparkSession, d: str) -> TargetSample:
    return TargetSample(table(spark, d, "stratified_stance_sample"), table(spark, d, "stance_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report().where("short").select("dimension", "stance")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report().select("dimension", "stance", "available", "required", "drawn", "short")


def p4_drawn(spark: SparkSession, d: str) -> DataFrame:
    """What the rows of the sample add up to, by cell."""
    return _sample(spark, d).rows().groupBy("dimension", "stance").agg(F.count("*").alias("drawn"), F.max("rank").cast("bigint").alias("last_rank"), F.count_if(F.col("rule") == "floor").alias("by_floor"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).rows()


def _lines(spark: SparkSession, d: str) -> SiteLines:
    return SiteLines(table(spark, d, BR), table(spark, d, "platform_party_map"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).occurrences().select("chunk_id", "line_no").distinct()


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).cleaned().distinct()


def _repaired(spark: SparkSession, d: str, **more) -> DataFrame:
    chunks = table(spark, d, BR)
    return repaired(chunks, fit(chunks), **more)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d, with_text=False).select("chunk_id", F.explode("kinds").alias("kind")).distinct()


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).distinct()


def _scored(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "chunk_topics").where("topic >= 0").select("chunk_id", F.col("topic").cast("bigint").alias("topic")).distinct()
    texts = table(spark, d, US).where("chunk_text is not null").select("chunk_id", "doc_id", "chunk_text")
    return term_distinctiveness(topics.join(texts, "chunk_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return top_terms(_scored(spark, d)).select("topic", "term")


def p7_residuals(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.select("topic", "term", "documents", "documents_all", F.round("residual", 6).alias("residual"), F.round("adjusted", 6).alias("adjusted"), "weight")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(_leaks(spark, d)).select("item_id", "documents", F.round("most_share", 6).alias("most_share"))


def _mixed(spark: SparkSession, d: str, **more) -> SourceMix:
    """Sizes in tokens of the vocabulary file that the setting `spark.platlens.tokenizer` names, by default TOKENIZER; a missing
    file is an error. Pieces between white space are counted only if the setting says "none"."""
    named = spark.conf.get("spark.platlens.tokenizer", TOKENIZER)
    return SourceMix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=None if named == "none" else named, **more)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).report().where("short").select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).report()


def p9_report_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The report with sizes in pieces between white space, which SQL can count as well."""
    r = SourceMix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=None).report()
    return r.select("source", "available", "slots", "filled_slots", "reached_size", "short")


def p9_mix_pieces(spark: SparkSession, d: str) -> DataFrame:
    """What the mix with such sizes adds up to, by source."""
    m = SourceMix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=None).mix()
    return m.groupBy("source").agg(F.count_distinct("slot").alias("filled_slots"), F.sum(F.col("to_token") - F.col("from_token")).alias("reached_size"), (F.max("pass") + 1).alias("passes"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).mix()


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).where("not is_prose").select("doc_id").distinct()


def p10_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Characters, lines and share of digits of every document that has a text, which SQL can count as well."""
    return _quality(spark, d).where("is_prose is not null").select("doc_id", "chars", "lines")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        p1_found, p1_term_frequencies, p2_found, p2_text_ends, p2_sentences, p3_found, p3_classes, p4_found, p4_report, p4_drawn, p4_sample, p5_found, p5_cleaned, p6_found, p6_repaired,
        p7_found, p7_residuals, p8_found, p8_leaked_items, p9_found, p9_report, p9_report_pieces, p9_mix_pieces, p9_mix, p10_found, p10_lengths, p10_statistics,
    )
    return {f.__name__: f for f in own}


_TERMS = """
WITH r AS (SELECT DISTINCT doc_id, tokens FROM wf_tokens WHERE tokens IS NOT NULL),
t AS (SELECT doc_id, unnest(string_split_regex(lower(nfc_normalize(tokens)), '\\s+')) AS term FROM r),
k AS (SELECT * FROM t WHERE term <> '' AND term <> 'eos'),
n AS (SELECT count(DISTINCT doc_id) AS docs FROM k),
g AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM k GROUP BY term),
m AS (SELECT term, tf, df, docs, CASE WHEN df < 3 THEN 'rare' WHEN df > 0.4 * docs THEN 'common' END AS mark FROM g, n)
"""

_SIMILAR = """
WITH c AS (
  SELECT DISTINCT 'us' AS corpus, doc_id, chunk_id, chunk_text FROM campaignview_chunks_sent WHERE chunk_text IS NOT NULL
  UNION SELECT DISTINCT 'br', doc_id, chunk_id, chunk_text FROM br_manifestos_chunks_sent WHERE chunk_text IS NOT NULL),
d AS (SELECT corpus, doc_id, lower(string_agg(chunk_text, ' ' ORDER BY CAST(regexp_extract(chunk_id, '#s(\\d+)$', 1) AS BIGINT))) AS t FROM c GROUP BY ALL),
w AS (SELECT corpus, doc_id, regexp_extract_all(t, '[\\p{L}\\p{N}]+') AS w FROM d),
s AS (SELECT DISTINCT corpus, doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM (SELECT corpus, doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
n AS (SELECT corpus, doc_id, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT x.corpus, x.doc_id AS doc_a, y.doc_id AS doc_b, count(*) AS both_ FROM s x JOIN s y ON x.corpus = y.corpus AND x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT b.corpus, doc_a, doc_b FROM b JOIN n p ON p.corpus = b.corpus AND p.doc_id = doc_a JOIN n q ON q.corpus = b.corpus AND q.doc_id = doc_b
WHERE both_ >= 0.6 * (p.n + q.n - both_)
"""

_CELLS = """
WITH u AS (SELECT sid, min((lower(trim(dimension, ' \t')), lower(trim(stance, ' \t')))) AS s FROM stratified_stance_sample WHERE sid IS NOT NULL AND dimension IS NOT NULL AND stance IS NOT NULL GROUP BY sid),
n AS (SELECT count(*) // 4 AS n FROM u),
a AS (SELECT s, count(*) AS k FROM u GROUP BY s),
r AS (SELECT t.dimension, t.stance, coalesce(a.k, 0) AS available, CAST(greatest(t.min_rows, ceil(t.target_permille * n.n / 1000.0)) AS BIGINT) AS required
      FROM stance_targets t CROSS JOIN n LEFT JOIN a ON a.s = (lower(trim(t.dimension, ' \t')), lower(trim(t.stance, ' \t'))))
"""

# Seats by the divisor method, every rank of a cell spelled out: the minimum first, then the smallest priorities.
_SEATS = _CELLS + """, c AS (SELECT t.dimension, t.stance, row_number() OVER (ORDER BY lower(trim(t.dimension, ' \t')), lower(trim(t.stance, ' \t'))) AS cell, coalesce(a.k, 0) AS k, t.min_rows AS m, t.target_permille AS p
      FROM stance_targets t LEFT JOIN a ON a.s = (lower(trim(t.dimension, ' \t')), lower(trim(t.stance, ' \t')))),
q AS (SELECT *, unnest(range(1, k + 1)) AS rank FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY rank > m, CASE WHEN rank > m THEN (rank - 0.5) / p ELSE 0 END, cell) AS place FROM q WHERE p > 0 OR rank <= m),
d AS (SELECT dimension, stance, count(*) AS drawn, max(rank) AS last_rank, count(*) FILTER (WHERE rank <= m) AS by_floor FROM o, n WHERE place <= n.n GROUP BY 1, 2)
"""

_LINES = """
WITH p AS (SELECT platform_id AS doc_id, min(upper(trim(party))) AS party FROM platform_party_map WHERE trim(party) <> '' GROUP BY 1),
c AS (SELECT DISTINCT b.doc_id, b.chunk_id, b.chunk_text, p.party FROM br_manifestos_chunks_sent b JOIN p USING (doc_id)),
n AS (SELECT party, count(DISTINCT doc_id) AS n FROM c GROUP BY party),
l AS (SELECT party, doc_id, chunk_id, i - 1 AS line_no, regexp_extract_all(lower(string_split(chunk_text, chr(10))[i]), '[\\p{L}\\p{N}]+') AS w
      FROM (SELECT *, unnest(range(1, len(string_split(chunk_text, chr(10))) + 1)) AS i FROM c WHERE chunk_text IS NOT NULL)),
g AS (SELECT party, w, count(DISTINCT doc_id) AS k FROM l WHERE len(w) >= 4 GROUP BY ALL),
y AS (SELECT g.party, g.w FROM g JOIN n USING (party) WHERE k >= 3 AND k * 5 >= n)
SELECT DISTINCT chunk_id, CAST(line_no AS BIGINT) AS line_no FROM l JOIN y ON l.party = y.party AND l.w = y.w
"""

_TOPIC_TERMS = """
WITH j AS (SELECT DISTINCT CAST(t.topic AS BIGINT) AS topic, c.doc_id, c.chunk_text FROM chunk_topics t JOIN campaignview_chunks_sent c USING (chunk_id) WHERE t.topic >= 0 AND c.chunk_text IS NOT NULL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM j),
w AS (SELECT DISTINCT topic, doc_id, unnest(regexp_extract_all(lower(chunk_text), '\\p{L}{3,}')) AS term FROM j),
a AS (SELECT topic, term, count(DISTINCT doc_id) AS a FROM w GROUP BY ALL),
d AS (SELECT term, count(DISTINCT doc_id) AS d FROM w GROUP BY ALL),
z AS (SELECT topic, count(DISTINCT doc_id) AS r FROM j GROUP BY ALL),
s AS (SELECT topic, term, a, d, n, r, round(a * ln(n / d), 6) AS weight FROM a JOIN d USING (term) JOIN z USING (topic), n)
"""

_LEAKS = """
WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
x AS (SELECT DISTINCT item_id, array_to_string(w[k:k+9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i WHERE len(w) > 9)),
y AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+9], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d WHERE len(w) > 9))
"""

# The longest run of words that a document and an item share: windows that match along one diagonal without a gap.
_RUNS = _LEAKS.rsplit("x AS (", 1)[0] + """x AS (SELECT item_id, len(w) AS n, k, array_to_string(w[k:k+9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i WHERE len(w) > 9)),
y AS (SELECT doc_id, k AS j, array_to_string(w[k:k+9], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d WHERE len(w) > 9)),
m AS (SELECT doc_id, item_id, n, j - k AS diagonal, k - row_number() OVER (PARTITION BY doc_id, item_id, j - k ORDER BY k) AS part FROM x JOIN y USING (s)),
r AS (SELECT doc_id, item_id, n, count(*) + 9 AS run FROM m GROUP BY doc_id, item_id, n, diagonal, part), b AS (SELECT doc_id, item_id, max(run / n) AS share FROM r GROUP BY 1, 2)
SELECT item_id, count(*) AS documents, round(max(share), 6) AS most_share FROM b GROUP BY 1
"""

# Documents with their sets of word runs; equal sets make copies, alike ones links, and links classes.
_CLASSES = _SIMILAR.replace("WITH c AS", "WITH RECURSIVE c AS").rsplit("SELECT b.corpus", 1)[0] + """,
f AS (SELECT corpus, doc_id, md5(string_agg(s, chr(31) ORDER BY s)) AS h FROM s GROUP BY ALL),
l AS MATERIALIZED (SELECT b.corpus, doc_a AS x, doc_b AS y FROM b JOIN n p ON p.corpus = b.corpus AND p.doc_id = doc_a JOIN n q ON q.corpus = b.corpus AND q.doc_id = doc_b WHERE both_ >= 0.6 * (p.n + q.n - both_)),
e AS MATERIALIZED (SELECT corpus, x, y FROM l UNION ALL SELECT corpus, y, x FROM l),
r(corpus, doc, top) AS (SELECT corpus, doc_id, doc_id FROM f UNION SELECT e.corpus, e.y, r.top FROM r JOIN e ON e.corpus = r.corpus AND e.x = r.doc WHERE r.top < e.y)
SELECT f.corpus, f.doc_id AS doc, m.class, coalesce(k.links, 0) AS links, c.copies FROM f JOIN (SELECT corpus, doc, min(top) AS class FROM r GROUP BY 1, 2) m ON m.corpus = f.corpus AND m.doc = f.doc_id
LEFT JOIN (SELECT e.corpus, e.x, count(DISTINCT g.h) AS links FROM e JOIN f g ON g.corpus = e.corpus AND g.doc_id = e.y JOIN f o ON o.corpus = e.corpus AND o.doc_id = e.x WHERE g.h <> o.h GROUP BY 1, 2) k ON k.corpus = f.corpus AND k.x = f.doc_id
JOIN (SELECT corpus, h, count(*) AS copies FROM f GROUP BY 1, 2) c ON c.corpus = f.corpus AND c.h = f.h
"""

# Chunks with the lines of their party that stand in too many of its documents taken out.
_CLEANED = _LINES.rsplit("SELECT DISTINCT chunk_id", 1)[0] + """,
o AS (SELECT DISTINCT b.doc_id, b.chunk_id, b.chunk_text, p.party FROM br_manifestos_chunks_sent b LEFT JOIN p USING (doc_id) WHERE b.doc_id IS NOT NULL),
x AS (SELECT *, unnest(range(1, len(string_split(chunk_text, chr(10))) + 1)) AS i FROM o WHERE chunk_text IS NOT NULL),
z AS (SELECT x.doc_id, x.chunk_id, x.chunk_text, x.i, string_split(chunk_text, chr(10))[x.i] AS line, y.w IS NOT NULL AS gone FROM x LEFT JOIN y ON y.party = x.party AND y.w = regexp_extract_all(lower(string_split(chunk_text, chr(10))[x.i]), '[\\p{L}\\p{N}]+'))
SELECT DISTINCT chunk_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS chunk_text, CAST(count(*) FILTER (gone) AS INTEGER) AS lines_removed FROM z GROUP BY doc_id, chunk_id, z.chunk_text
UNION SELECT chunk_id, NULL, 0 FROM o WHERE chunk_text IS NULL
"""

_ENDS = """
WITH t AS (SELECT chunk_id, chunk_text FROM campaignview_chunks_sent UNION SELECT chunk_id, chunk_text FROM br_manifestos_chunks_sent)
SELECT DISTINCT chunk_id, CAST(length(regexp_replace(chunk_text, '[\\s\\p{Z}]+$', '')) AS BIGINT) AS reach, true AS rising, false AS blank_end FROM t WHERE chunk_text IS NOT NULL AND NOT contains(chunk_text, chr(10)) AND regexp_matches(chunk_text, '[\\p{L}\\p{N}]')
"""

_MIX = """
WITH s AS (SELECT lower(trim(source)) AS s, CASE WHEN trim(text) = '' OR text IS NULL THEN 0 ELSE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) END AS n FROM documents),
t AS (SELECT source, lower(trim(source)) AS s, target_permille AS p, max_repeat AS r FROM mix_targets),
g AS (SELECT t.source, p, r, coalesce(sum(n), 0) AS n FROM t LEFT JOIN s USING (s) GROUP BY ALL),
k AS (SELECT sum(n) AS k FROM g)
SELECT source FROM g, k WHERE n * r * 1000 < p * k
"""

# The schedule of slots at golden-ratio points, sizes in pieces between white space.
_SLOTS = _MIX.rsplit("SELECT source FROM", 1)[0].replace("'\\s+'", "'[\\s\\p{Z}]+'") + """,
o AS (SELECT *, sum(p) OVER (ORDER BY lower(trim(source))) AS upto, sum(p) OVER () AS all_ FROM g),
i AS (SELECT unnest(range(0, CAST(ceil(k / 512.0) AS BIGINT))) AS slot FROM k),
u AS (SELECT slot, (slot + 0.5) * CAST('0.6180339887498949' AS DOUBLE) - floor((slot + 0.5) * CAST('0.6180339887498949' AS DOUBLE)) AS u FROM i),
w AS (SELECT source, count(*) AS slots FROM u JOIN o ON u < CAST(upto AS DOUBLE) / greatest(1000, all_) AND u >= CAST(upto - p AS DOUBLE) / greatest(1000, all_) GROUP BY 1),
b AS (SELECT o.source, n, r, p, coalesce(slots, 0) AS slots, CAST(ceil(n / 512.0) AS BIGINT) AS blocks, least(coalesce(slots, 0), CAST(ceil(n / 512.0) AS BIGINT) * r) AS filled FROM o LEFT JOIN w USING (source)),
q AS (SELECT *, CASE WHEN blocks = 0 THEN 0 ELSE filled // blocks END AS full_, CASE WHEN blocks = 0 THEN 0 ELSE filled % blocks END AS rest FROM b)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p1_term_frequencies": _TERMS + "SELECT term, tf, df, docs, mark FROM m",
        "p2_text_ends": _ENDS,
        "p3_found": _SIMILAR,
        "p3_classes": _CLASSES,
        "p4_found": _CELLS + "SELECT dimension, stance FROM r WHERE available < required",
        "p4_report": _SEATS + "SELECT dimension, stance, available, required, coalesce(drawn, 0) AS drawn, available < required AS short FROM r LEFT JOIN d USING (dimension, stance)",
        "p4_drawn": _SEATS + "SELECT * FROM d",
        "p5_found": _LINES,
        "p5_cleaned": _CLEANED,
        "p7_found": _TOPIC_TERMS + "SELECT topic, term FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS k FROM s) WHERE k <= 5",
        "p7_residuals": _TOPIC_TERMS + "SELECT topic, term, a AS documents, d AS documents_all, round((a - r * d / n) / sqrt(r * d / n), 6) AS residual, CASE WHEN (1 - r / n) * (1 - d / n) > 0 THEN round((a - r * d / n) / sqrt(r * d / n * (1 - r / n) * (1 - d / n)), 6) END AS adjusted, weight FROM s",
        "p8_found": _LEAKS + "SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (s)",
        "p8_leaked_items": _RUNS,
        "p9_found": _MIX,
        "p9_report_pieces": _SLOTS + "SELECT source, CAST(n AS BIGINT) AS available, slots, CAST(filled AS BIGINT) AS filled_slots, CAST(full_ * n + least(rest * 512, n) AS BIGINT) AS reached_size, n * r * 1000 < p * k AS short FROM q, k",
        "p9_mix_pieces": _SLOTS + "SELECT source, CAST(filled AS BIGINT) AS filled_slots, CAST(full_ * n + least(rest * 512, n) AS BIGINT) AS reached_size, CAST(full_ + CASE WHEN rest > 0 THEN 1 ELSE 0 END AS BIGINT) AS passes FROM q WHERE filled > 0",
        "p10_lengths": "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents WHERE regexp_matches(text, '[^\\s\\p{Z}]')",
    }
