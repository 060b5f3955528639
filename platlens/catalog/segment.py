"""Queries about chunks, lines, layout and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import screen, segment
from ..plans import lineage
from ..sources.tables import table
from . import query

_W = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
_LINES = "l AS (SELECT doc_id, i - 1 AS n, trim(string_split(text, chr(10))[i]) AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"


def _lines(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.trim("line"))


def _count(c):
    return F.size(F.regexp_extract_all(c, F.lit(_W), F.lit(0))).cast("bigint")


_WQ = _W.replace("'", "''")


@query(f"WITH {_LINES} SELECT doc_id || '#s' || n AS chunk_id, CAST(len(regexp_extract_all(line, '{_WQ}')) AS BIGINT) AS word_count FROM l WHERE line <> ''")
def chunk_lines(spark, d):
    x = _lines(spark, d).where("line <> ''")
    return x.select(F.concat(F.col("doc_id").cast("string"), F.lit("#s"), F.col("n").cast("string")).alias("chunk_id"), _count(F.col("line")).alias("word_count"))


@query(f"WITH {_LINES}, w AS (SELECT len(regexp_extract_all(line, '{_WQ}')) AS n FROM l WHERE line <> '') SELECT count(*) AS chunks, round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.9), 4) AS p90, round(quantile_cont(n, 0.99), 4) AS p99, round(avg(CAST(n <= 6 AS INT)), 6) AS short_share, round(avg(CAST(n > 150 AS INT)), 6) AS long_share FROM w")
def chunk_length_report(spark, d):
    n = _count(F.col("line"))
    w = _lines(spark, d).where("line <> ''").select(n.alias("n"))
    p = lambda q: F.round(F.percentile("n", q), 4)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return w.agg(F.count("*").alias("chunks"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), share(F.col("n") <= 6).alias("short_share"), share(F.col("n") > 150).alias("long_share"))


@query(f"WITH {_LINES} SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' AND len(string_split_regex(line, '\\s+')) <= 30 GROUP BY ALL HAVING count(*) >= 3")
def repeated_line_furniture(spark, d):
    x = _lines(spark, d).where((F.col("line") != "") & (F.size(F.split("line", r"\s+")) <= 30))
    return x.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n >= 3")


def _per_text(f):
    """A function of a text that gives pieces, as a column function."""
    return F.pandas_udf(lambda s: s.map(f), "array<string>")


def _pieces(spark, d, f, name="piece"):
    """doc_id, n (from 0) and piece of every piece that f makes of a document's text; documents of an id once."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return lineage.spread(t).select("doc_id", F.posexplode(_per_text(f)("text")).alias("n", name))


# Lines as the rules see them: stripped, with their words counted, and whether they begin as if a sentence went on.
_S = "[\\s\\p{Z}]"
_STRIPPED = f"""
r AS (SELECT doc_id, i - 1 AS n, string_split(text, chr(10))[i] AS raw FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, n, regexp_replace(raw, '{_S}+$', '') AS source, regexp_replace(raw, '^{_S}+|{_S}+$', '', 'g') AS line FROM r),
w AS (SELECT *, len(regexp_extract_all(line, '{_WQ}')) AS words, regexp_matches(line, '^[^\\p{{L}}\\p{{N}}_]*[\\p{{Ll}}\\p{{Nd}}ªº]') AS goes_on FROM s)"""


def _stripped(t):
    return [y for x in t.split("\n") if (y := x.strip())]


@query(f"""WITH {_STRIPPED}, a AS (SELECT doc_id, line AS f FROM w WHERE line <> '' GROUP BY 1, 2 HAVING count(*) >= 3 AND any_value(words) BETWEEN 1 AND 30),
p AS (SELECT doc_id, string_split_regex(line, '{_S}+') AS t FROM w WHERE line <> ''), k AS (SELECT doc_id, t, unnest(range(5, least(len(t), 30))) AS k FROM p),
b AS (SELECT doc_id, array_to_string(t[:k], ' ') AS f FROM k GROUP BY 1, 2 HAVING count(*) >= 3 AND length(trim(any_value(t[k]), ',;:.')) >= 5),
c AS (SELECT doc_id, f, true AS whole FROM a UNION ALL SELECT doc_id, f, false FROM b WHERE (doc_id, f) NOT IN (SELECT (doc_id, f) FROM a))
SELECT doc_id, f AS furniture FROM c WHERE whole OR NOT EXISTS (SELECT 1 FROM c x WHERE x.doc_id = c.doc_id AND x.f <> c.f AND contains(x.f, c.f))""")
def prefix_furniture(spark, d):
    """Lines and shared beginnings of lines that a document repeats."""
    return _pieces(spark, d, lambda t: segment.furniture(t.split("\n")), "furniture").select("doc_id", "furniture")


@query(f"""WITH {_STRIPPED}, l AS (SELECT doc_id, count(*) AS lines, list_sort(list(length(source)) FILTER (source <> '')) AS lens FROM w GROUP BY 1),
m AS (SELECT doc_id, lines, len(lens) AS k, CASE WHEN len(lens) > 0 THEN lens[1 + CAST(floor(0.9 * (len(lens) - 1)) AS BIGINT)] END AS measure FROM l),
j AS (SELECT w.*, lag(line) OVER o AS p, lag(length(source)) OVER o AS plen, m.* EXCLUDE (doc_id) FROM w JOIN m USING (doc_id) WINDOW o AS (PARTITION BY w.doc_id ORDER BY n)),
g AS (SELECT *, coalesce(lines >= 10 AND k > 0 AND line <> '' AND p <> '' AND right(p, 1) NOT IN ('.', '!', '?', ';', ':') AND ((measure >= 40 AND plen >= measure - 3) OR goes_on OR regexp_matches(p, '(^|{_S})[\\p{{L}}\\p{{N}}]{{1,2}}$') AND NOT regexp_matches(p, '\\p{{N}}.?$|\\p{{N}}$')), false) AS joins FROM j),
h AS (SELECT *, sum(CAST(NOT joins AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM g)
SELECT doc_id, part - 1 AS n, string_agg(line, ' ' ORDER BY n) AS line FROM h GROUP BY doc_id, part HAVING string_agg(line, ' ' ORDER BY n) <> ''""")
def unwrapped_lines(spark, d):
    """Lines after those that the page's measure broke are joined; n counts lines from 0, blank ones included."""
    x = _pieces(spark, d, lambda t: [y.strip() for y in segment.unwrap(t).split("\n")], "line")
    return x.where("line <> ''").select("doc_id", F.col("n").cast("bigint").alias("n"), "line")


@query(f"""WITH {_STRIPPED}, b AS (SELECT doc_id, n, array_to_string(string_split_regex(line, '{_S}+'), ' ') AS line FROM w WHERE line <> ''),
x AS (SELECT *, regexp_extract(line, '^((?:[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ0-9''’.º°-]* ){{1,10}})[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]', 1) AS run FROM b),
y AS (SELECT *, regexp_extract(trim(run), '^(\\S.*?)((?: [A-ZÀ-ÖØ-Þ]\\.*)*)$', 1) AS head FROM x WHERE run <> ''),
z AS (SELECT *, len(string_split(head, ' ')) AS k, substr(line, length(head) + 2) AS tail FROM y)
SELECT doc_id, n, head, tail FROM z WHERE len(regexp_extract_all(tail, '{_WQ}')) >= 3 AND (k >= 2 OR length(head) >= 5 AND regexp_matches(tail, '^[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]'))""")
def caps_heads(spark, d):
    """Headings in capitals that run into the text of their line."""
    cut = _per_text(lambda x: segment.split_caps_head(" ".join(x.split())))
    lines = _lines(spark, d).withColumn("parts", cut("line")).where(F.size("parts") == 2)
    return lines.select("doc_id", F.col("n").cast("bigint").alias("n"), F.col("parts")[0].alias("head"), F.col("parts")[1].alias("tail"))


@query(f"""WITH {_STRIPPED}, x AS (SELECT doc_id, n, line, words, right(line, 1) = ':' AND left(line, 1) NOT IN ('{"', '".join(segment.MARKERS)}') AND words <= 12 AS is_head FROM w WHERE line <> ''),
e AS (SELECT *, CASE WHEN is_head THEN line WHEN words > 8 THEN '' END AS sets FROM x),
f AS (SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS head FROM e)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n, CASE WHEN is_head OR head = '' THEN line ELSE regexp_replace(left(head, length(head) - 1), '{_S}+$', '') || ': ' || line END AS unit FROM f""")
def colon_lists(spark, d):
    """Lines of a document as units, short ones with the heading they stand under."""
    return _pieces(spark, d, lambda t: segment.fix_colon_lists(_stripped(t)), "unit").withColumn("n", F.col("n").cast("bigint"))


@query(f"""WITH {_STRIPPED}, x AS (SELECT doc_id, n, line, words <= 4 AND goes_on AND row_number() OVER (PARTITION BY doc_id ORDER BY n) > 1 AS joins FROM w WHERE line <> ''),
g AS (SELECT *, sum(CAST(NOT joins AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM x)
SELECT doc_id, CAST(part - 1 AS BIGINT) AS n, string_agg(line, ' ' ORDER BY n) AS piece FROM g GROUP BY doc_id, part""")
def stranded_lines(spark, d):
    """Lines with the short ones that go on put back."""
    return _pieces(spark, d, lambda t: segment.reattach_stranded(_stripped(t))).withColumn("n", F.col("n").cast("bigint"))


@query(f"""WITH RECURSIVE {_STRIPPED}, x AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, line, words FROM w WHERE line <> ''),
f(doc_id, i, part, held) AS (SELECT doc_id, i, 1, words FROM x WHERE i = 1 UNION ALL
  SELECT x.doc_id, x.i, CASE WHEN f.held < 5 THEN f.part ELSE f.part + 1 END, CASE WHEN f.held < 5 THEN f.held + x.words ELSE x.words END FROM f JOIN x ON x.doc_id = f.doc_id AND x.i = f.i + 1),
l AS (SELECT doc_id, max(part) AS last, arg_max(held, i) AS held FROM f GROUP BY 1),
m AS (SELECT f.doc_id, f.i, CASE WHEN part = last AND last > 1 AND l.held < 5 THEN part - 1 ELSE part END AS part FROM f JOIN l USING (doc_id))
SELECT m.doc_id, CAST(part - 1 AS BIGINT) AS n, string_agg(line, ' ' ORDER BY m.i) AS piece FROM m JOIN x ON x.doc_id = m.doc_id AND x.i = m.i GROUP BY m.doc_id, part""")
def long_enough_lines(spark, d):
    """Lines merged until each piece has five words."""
    return _pieces(spark, d, lambda t: segment.enforce_min_words(_stripped(t))).withColumn("n", F.col("n").cast("bigint"))


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(text, '{_S}+'), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
c AS MATERIALIZED (SELECT doc_id, i, p[i] AS piece, len(regexp_extract_all(p[i], '{_WQ}')) AS words FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM t)),
u AS MATERIALIZED (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM c),
a AS MATERIALIZED (SELECT doc_id, list(upto ORDER BY i) AS upto, len(list(upto)) AS k FROM u GROUP BY 1 HAVING max(upto) > 150),
s(doc_id, no, i, j) AS (
  SELECT doc_id, 0, CAST(0 AS BIGINT), greatest(1, len(list_filter(upto, lambda x: x <= 150))) FROM a UNION ALL
  SELECT doc_id, no + 1, b, greatest(b + 1, len(list_filter(upto, lambda x: x <= before + 150))) FROM (
    SELECT doc_id, no, upto, b, CASE WHEN b = 0 THEN 0 ELSE upto[b] END AS before FROM (
      SELECT s.doc_id, no, a.upto, greatest(s.i + 1, len(list_filter(a.upto, lambda x: x <= a.upto[s.j] - 10))) AS b FROM s JOIN a USING (doc_id) WHERE s.j < a.k)))
SELECT doc_id, CAST(no AS BIGINT) AS n, array_to_string(p[i + 1:j], ' ') AS piece FROM s JOIN t USING (doc_id)""")
def stride_windows(spark, d):
    """Windows of at most 150 words over the texts that have more."""
    x = _pieces(spark, d, lambda t: w if len(w := segment.stride_split(t)) > 1 else [])
    return x.withColumn("n", F.col("n").cast("bigint"))


@query()
def segment_documents(spark, d):
    """The whole cascade from documents to chunks."""
    return segment.chunk_documents(table(spark, d, "documents"))


@query()
def screen_features(spark, d):
    return screen.screen_features(table(spark, d, "documents"))


@query()
def screen_arms(spark, d):
    """Documents that some arms of the screen take for something else than a platform."""
    return screen.screen_features(table(spark, d, "documents")).select("doc", screen.arms().alias("arms")).where("arms <> ''")


# Features from the digits of a part's numbers: every arm fires for some.
_DIGITS = {"n_lines": "k % 13", "n_words": "k * 37 % 1500", "n_clause": "k % 3", "n_label": "k % 7", "n_number": "k % 5", "n_prop": "k % 4 // 2", "n_table": "k % 23", "n_item": "k % 11", "n_table_prop": "k % 6 // 4", "n_domain_item": "k % 3 // 2", "n_bullet": "k % 5", "bio": "k % 5", "campaign": "k % 4", "judicial": "k % 5", "party_act": "k % 4", "defer": "k % 3 // 2"}


@query("WITH k AS (SELECT p_partkey AS k FROM part), f AS (SELECT k, " + ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in _DIGITS.items()) + """, k % 2 = 0 AS appeal, k % 10 / 10.0 AS judicial_deep, CAST(k % 40 AS VARCHAR) || '.' || CAST(k % 7 AS VARCHAR) || ' x' AS first_line, k % 40 AS a, k % 7 AS b FROM k), g AS (SELECT *, n_prop = 0 AND n_table_prop = 0 AS o FROM f)
SELECT k AS doc, CASE WHEN n_lines = 0 THEN 'D' ELSE CASE WHEN campaign >= 2 THEN 'A' ELSE '' END || CASE WHEN judicial >= 2 AND o AND (judicial_deep >= 0.4 OR n_words < 600) THEN 'B' ELSE '' END || CASE WHEN bio >= 3 AND appeal AND n_bullet <= 2 AND n_words < 2000 AND o THEN 'C' ELSE '' END
|| CASE WHEN n_clause = 0 AND o AND n_domain_item = 0 THEN 'D' ELSE '' END || CASE WHEN n_label >= 4 AND o AND n_item <= 5 AND n_clause <= 6 AND (appeal OR bio >= 1) THEN 'E' ELSE '' END || CASE WHEN a <= 30 AND b <= 30 AND (a > 1 OR b > 1) THEN 'F' ELSE '' END
|| CASE WHEN n_table >= 10 AND n_prop = 0 AND n_clause <= 6 AND n_table_prop < 0.35 * n_table THEN 'G' ELSE '' END || CASE WHEN n_number >= 3 AND n_number >= 0.15 * n_lines AND n_clause = 0 THEN 'H' ELSE '' END || CASE WHEN party_act >= 2 AND o THEN 'I' ELSE '' END || CASE WHEN n_label >= 4 AND o AND defer >= 1 THEN 'J' ELSE '' END END AS arms FROM g""")
def screen_rules(spark, d):
    """The arms over features made from numbers, so that each rule meets both outcomes."""
    k = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    f = k.select(F.col("k").alias("doc"), *(F.expr(f"cast({e.replace('//', 'div')} as bigint)").alias(n) for n, e in _DIGITS.items()), (F.col("k") % 2 == 0).alias("appeal"), (F.col("k") % 10 / 10).alias("judicial_deep"), F.concat((F.col("k") % 40).cast("string"), F.lit("."), (F.col("k") % 7).cast("string"), F.lit(" x")).alias("first_line"))
    return f.select("doc", screen.arms().alias("arms"))


@query("""WITH p AS (SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS label FROM part) SELECT p_partkey, label, CAST(len(list_filter(string_split(label, ' '), lambda w: lower(w) NOT IN ('and', 'of', 'the'))) AS BIGINT) AS words, label = '' OR length(label) > 20 AS flagged FROM p""")
def label_checks(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.trim(F.regexp_replace("p_name", r"\s+", " ")).alias("label"))
    words = F.size(F.filter(F.split("label", " "), lambda w: ~F.lower(w).isin("and", "of", "the"))).cast("bigint")
    return p.select("p_partkey", "label", words.alias("words"), ((F.col("label") == "") | (F.length("label") > 20)).alias("flagged"))


@query("SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_labels(spark, d):
    return table(spark, d, "part").groupBy(F.lower(F.trim(F.regexp_replace("p_name", r"\s+", " "))).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT chunk_id, CAST(len(regexp_extract_all(chunk_text, '[.!?…]')) AS BIGINT) AS stops, regexp_matches(chunk_text, '[.!?…]\\S*\\s+\\S') AS needs_segmenter, regexp_matches(ltrim(chunk_text), '^\\p{Ll}') AS starts_lower FROM (SELECT DISTINCT chunk_id, chunk_text FROM campaignview_chunks_sent WHERE chunk_text IS NOT NULL)")
def segmenter_gate(spark, d):
    c = table(spark, d, "campaignview_chunks_sent").where("chunk_text is not null").select("chunk_id", "chunk_text").distinct()
    t = F.col("chunk_text")
    return c.select("chunk_id", F.size(F.regexp_extract_all(t, F.lit("[.!?…]"), F.lit(0))).cast("bigint").alias("stops"), t.rlike(r"[.!?…]\S*\s+\S").alias("needs_segmenter"), F.ltrim(t).rlike(r"^\p{Ll}").alias("starts_lower"))


@query()
def text_normalised(spark, d):
    """JVM-side repairs: missing spaces behind stops, collapsed repetitions, rules of dashes, squeezed white space."""
    t = F.regexp_replace("chunk_text", r"(?<=\p{Ll})([.!?])(?=\p{Lu})", "$1 ")
    t = F.regexp_replace(t, r"(?i)(.{6,120}?)(?:\s+\1){3,}", "$1")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[-–_=.]{4,}", " "), r"\s+", " "))
    return table(spark, d, "campaignview_chunks_sent").where("chunk_text is not null").select("chunk_id", t.alias("chunk_text")).distinct()
