"""Token streams, vocabularies, collocations and class terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[a-zà-ÿ][a-zà-ÿ]+"


# Words that turn a statement round, kept even where a list of stop words has them.
NEGATIONS = "no not nor never none without não nem nunca nenhum nenhuma sem jamais ni sin ningún".split()


def tokenise(text: Column, stop: list[str] = (), keep: list[str] = NEGATIONS) -> Column:
    """Lower-case runs of at least two Latin letters, without stop words, of which those in `keep` stay."""
    t = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    gone = sorted(set(stop) - set(keep))
    return F.filter(t, lambda w: ~w.isin(gone)) if gone else t


def token_stream(df: DataFrame, doc: str, order: str, tokens: str, eos: str = "eos") -> DataFrame:
    """doc, tokens: the token arrays of a document in order, one string with a sentinel between them; empty ones are left out."""
    t = F.array_join(tokens, " ")
    rows = df.select(doc, F.col(order).alias("o"), t.alias("t")).where("t <> ''")
    g = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("s"))
    return g.select(doc, F.array_join(F.col("s.t"), f" {eos} ").alias("tokens"))


def vocabulary(df: DataFrame, doc: str, tokens: str) -> DataFrame:
    """token, tf, df; (token, document) pairs are combined before they are shuffled."""
    pairs = df.select(doc, F.explode(tokens).alias("token")).groupBy("token", doc).agg(F.count("*").alias("n"))
    return pairs.groupBy("token").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def fold_rare(df: DataFrame, doc: str, tokens: str, least_tf: int, least_df: int, oov: str = "__oov__") -> DataFrame:
    """(doc, token, n) with rare tokens folded into one; lengths of documents stay."""
    n = df.select(doc, F.explode(tokens).alias("token")).groupBy(doc, "token").agg(F.count("*").alias("n"))
    keep = n.groupBy("token").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).select("token", ((F.col("tf") >= least_tf) & (F.col("df") >= least_df)).alias("ok"))
    return n.join(keep, "token").groupBy(doc, F.when(F.col("ok"), F.col("token")).otherwise(oov).alias("token")).agg(F.sum("n").alias("n"))


def fold_to_target(dfm: DataFrame, doc: str, target: int, oov: str = "__oov__") -> DataFrame:
    """(doc, token, n) with all but the `target` most frequent tokens folded into one."""
    keep = dfm.where(F.col("token") != oov).groupBy("token").agg(F.sum("n").alias("tf")).orderBy(F.desc("tf"), "token").limit(target).select("token", F.lit(True).alias("ok"))
    return dfm.join(keep, "token", "left").groupBy(doc, F.when(F.col("ok"), F.col("token")).otherwise(oov).alias("token")).agg(F.sum("n").alias("n"))


def bigrams(df: DataFrame, tokens: str) -> DataFrame:
    """Neighbouring pairs (a, b) of every token array."""
    t = F.col(tokens)
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return df.where(F.size(t) > 1).select(F.explode(pairs).alias("p")).select("p.*")


def collocations(df: DataFrame, tokens: str, least: int = 50, floor: float = 0.4, target: int = 2000, barred: list[str] = ("eos",)) -> DataFrame:
    """bigram, npmi of pairs seen at least `least` times with an NPMI of at least `floor`, and of no less than the pair on
    rank `target` (ties stay)."""
    p = bigrams(df, tokens)
    n = p.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t")).scalar()
    left, right = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb"))
    big = n.where((F.col("n") >= least) & ~F.col("a").isin(list(barred)) & ~F.col("b").isin(list(barred)))
    s = big.join(left, "a").join(right, "b").withColumn("t", total)
    d = lambda c: F.col(c).cast("double")
    score = F.try_divide(F.log(d("n") * d("t") / (d("na") * d("nb"))), -F.log(F.nullif(d("n") / d("t"), F.lit(1.0))))
    kept = s.select(F.concat_ws("_", "a", "b").alias("bigram"), "n", F.round(score, 6).alias("npmi")).where(F.col("npmi") >= floor)
    cutoff = kept.orderBy(F.desc("npmi")).limit(target).agg(F.min("npmi").alias("c")).scalar()
    return kept.where(F.col("npmi") >= cutoff)


def glue(tokens: list[str], pairs: set[str]) -> list[str]:
    """Tokens with known pairs glued, greedily from the left."""
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and f"{tokens[i]}_{tokens[i + 1]}" in pairs:
            out.append(f"{tokens[i]}_{tokens[i + 1]}")
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def glued(df: DataFrame, tokens: str, pairs: DataFrame, most: int = 100_000) -> DataFrame:
    """df with the tokens of known pairs glued. The pair list is bounded by its target; a longer one is refused."""
    rows = pairs.select("bigram").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} collocations")
    known = {r.bigram for r in rows}

    @F.pandas_udf("array<string>")
    def run(t):
        return t.map(lambda x: None if x is None else glue(list(x), known))

    return df.withColumn(tokens, run(F.col(tokens)))


def stem_labels(vocab: DataFrame, stem: Column) -> DataFrame:
    """stem, label (its most frequent form), tf."""
    return vocab.withColumn("stem", stem).groupBy("stem").agg(F.max_by("token", F.struct("tf", "token")).alias("label"), F.sum("tf").alias("tf"))


def suffix_stem(token: Column) -> Column:
    """A light stem: plural and gender endings off words that stay at least three letters long."""
    return F.regexp_replace(token, r"(?<=\p{L}{3})(?:es|s|os|as|o|a)$", "")


def class_tfidf(terms: DataFrame, cls: str = "topic", k: int = 10) -> DataFrame:
    """Top k terms per class by row-normalised tf times ln(1 / (df / classes + 1e-6))."""
    n = terms.groupBy(cls, "token").agg(F.sum("n").alias("n"))
    size = n.groupBy(cls).agg(F.sum("n").alias("size"))
    dfs = n.groupBy("token").agg(F.count("*").alias("df"))
    classes = n.select(cls).distinct().agg(F.count("*").alias("c")).scalar()
    s = n.join(size, cls).join(dfs, "token").withColumn("c", classes)
    return _top(s, cls, F.col("n").cast("double") / F.col("size") * F.log(1 / (F.col("df").cast("double") / F.col("c") + 1e-6)), k)


def class_tfidf_average(terms: DataFrame, cls: str = "topic", k: int = 10) -> DataFrame:
    """Top k terms per class by tf times ln(1 + A / tf of all), A the mean size of a class."""
    n = terms.groupBy(cls, "token").agg(F.sum("n").alias("n"))
    size = n.groupBy(cls).agg(F.sum("n").alias("size"))
    mean = size.agg(F.avg("size").alias("a")).scalar()
    tf = n.groupBy("token").agg(F.sum("n").alias("tf"))
    s = n.join(size, cls).join(tf, "token").withColumn("a", mean)
    return _top(s, cls, F.col("n").cast("double") / F.col("size") * F.log(1 + F.col("a") / F.col("tf")), k)


def _top(s: DataFrame, cls: str, score: Column, k: int) -> DataFrame:
    w = Window.partitionBy(cls).orderBy(F.desc("score"), "token")
    return s.select(cls, "token", F.round(score, 8).alias("score")).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def keyword_spread(df: DataFrame, doc: str, tokens: str, keywords: DataFrame, cls: str = "topic") -> DataFrame:
    """Per class the median, over its keywords, of the documents that have the word."""
    used = df.select(doc, F.explode(F.array_distinct(tokens)).alias("token")).join(keywords.select("token").distinct(), "token", "left_semi")
    per = used.distinct().groupBy("token").agg(F.count("*").alias("docs"))
    return keywords.join(per, "token", "left").groupBy(cls).agg(F.median(F.coalesce("docs", F.lit(0))).alias("spread"))


def topic_coherence(df: DataFrame, doc: str, tokens: str, keywords: DataFrame, cls: str = "topic") -> DataFrame:
    """Per class the mean NPMI, over pairs of its keywords, of occurring in one document. Pairs are made within a document and
    class, of whose keywords there are few, and counted in each task before they are shuffled."""
    words = df.select(doc, F.explode(F.array_distinct(tokens)).alias("token"))
    has = words.join(keywords.select("token", cls), "token").distinct()
    n = df.select(doc).distinct().agg(F.count("*").alias("n")).scalar()
    single = has.select(doc, "token").distinct().groupBy("token").agg(F.count("*").alias("n"))
    sets = has.groupBy(doc, cls).agg(F.array_sort(F.collect_set("token")).alias("s"))
    pair = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = sets.select(cls, F.explode(pair).alias("p")).select(cls, "p.*").groupBy(cls, "a", "b").agg(F.count("*").alias("n"))
    k = keywords.select(cls, "token")
    wanted = k.withColumnRenamed("token", "a").join(k.withColumnRenamed("token", "b"), cls).where("a < b")
    j = wanted.join(both, [cls, "a", "b"], "left").join(single.select(F.col("token").alias("a"), F.col("n").alias("na")), "a", "left").join(single.select(F.col("token").alias("b"), F.col("n").alias("nb")), "b", "left").withColumn("t", n)
    d = lambda c: F.col(c).cast("double")
    npmi = F.when(F.col("n").isNull(), F.lit(-1.0)).when(F.col("n") == F.col("t"), F.lit(1.0)).otherwise(F.log(d("n") * d("t") / (d("na") * d("nb"))) / -F.log(d("n") / d("t")))
    return j.groupBy(cls).agg(F.round(F.avg(npmi), 6).alias("npmi"))


def topic_diversity(keywords: DataFrame) -> DataFrame:
    """Distinct keywords over all of them, in one row."""
    return keywords.agg(F.round(F.count_distinct("token").cast("double") / F.count("*"), 6).alias("diversity"))
