"""The document-by-topic cell table: counts of chunks (y) and signed stance sums (s), and what is made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORT_TOPIC = -2


def reroute_short(chunks: DataFrame, topic: str = "topic", words: str = "word_count", most: int = 6) -> DataFrame:
    """Chunks of at most `most` words get the short topic, also where they had none; other noise (-1, null) is dropped."""
    t = F.when(F.col(words) <= most, F.lit(SHORT_TOPIC)).otherwise(F.col(topic))
    return chunks.withColumn(topic, t).where((F.col(topic) >= 0) | (F.col(topic) == SHORT_TOPIC))


def with_group_size(df: DataFrame, key: str, name: str = "group_size") -> DataFrame:
    """Rows with the size of their group. Counted apart and joined, so that a hot group is never sorted in one task."""
    return df.join(df.groupBy(key).agg(F.count("*").alias(name)), key)


def keep_large_groups(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of groups of at least `least` rows."""
    return with_group_size(df, key).where(F.col("group_size") >= least).drop("group_size")


def cell_table(chunks: DataFrame, doc: str = "doc_id", topic: str = "topic", stance: str = "stance") -> DataFrame:
    """doc, topic, y (chunks), s (sum of their stances), mean stance s / y; one shuffle with partial sums."""
    out = chunks.groupBy(doc, topic).agg(F.count("*").alias("y"), F.sum(stance).alias("s"))
    return out.withColumn("mean_stance", F.col("s").cast("double") / F.col("y"))


def topic_totals(cells: DataFrame, topic: str = "topic") -> DataFrame:
    """topic, docfreq, y, mean stance and share of all chunks."""
    per = cells.groupBy(topic).agg(F.count("*").alias("docfreq"), F.sum("y").alias("y"), F.sum("s").alias("s"))
    total = cells.agg(F.sum("y").alias("n")).scalar()
    return per.select(topic, "docfreq", "y", F.round(F.col("s").cast("double") / F.col("y"), 6).alias("mean_stance"), F.round(F.col("y").cast("double") / total, 6).alias("share"))


def roll_up(cells: DataFrame, crosswalk: DataFrame, doc: str = "doc_id", topic: str = "topic", code: str = "code") -> DataFrame:
    """Cells summed in the classes of a crosswalk; topics without a class are left out (see uncovered)."""
    return cells.join(crosswalk.select(topic, code), topic).groupBy(doc, code).agg(F.sum("y").alias("y"), F.sum("s").alias("s")).where("y > 0")


def uncovered(cells: DataFrame, crosswalk: DataFrame, topic: str = "topic") -> DataFrame:
    """Topics of cells that a crosswalk does not cover, with their chunks."""
    return cells.join(crosswalk.select(topic), topic, "left_anti").groupBy(topic).agg(F.sum("y").alias("y"))


def drop_classes(cells: DataFrame, codes: list[str], doc: str = "doc_id", code: str = "code") -> tuple[DataFrame, DataFrame]:
    """(cells without these classes, documents left with nothing)."""
    kept = cells.where(~F.col(code).isin(codes))
    return kept, cells.select(doc).distinct().join(kept.select(doc).distinct(), doc, "left_anti")


def stance_composition(stances: DataFrame, topic: str = "topic", stance: str = "stance", least: int = 1) -> DataFrame:
    """Exact shares of left, neutral and right chunks per topic, of topics with at least `least` chunks."""

    def share(c: Column) -> Column:
        return F.round(F.avg(c.cast("double")), 6)

    s = F.col(stance)
    return stances.groupBy(topic).agg(F.count("*").alias("n"), share(s < 0).alias("left"), share(s == 0).alias("neutral"), share(s > 0).alias("right")).where(F.col("n") >= least)


def composition_of_cells(cells: DataFrame, topic: str = "topic", least: int = 1) -> DataFrame:
    """Shares from cell sums alone: |s| stands for the sided chunks, so opposing stances in one cell are understated."""
    g = cells.groupBy(topic).agg(F.sum("y").alias("n"), F.sum(F.abs("s")).alias("a"), F.sum("s").alias("s")).where(F.col("n") >= least)
    n, a, s = (F.col(c).cast("double") for c in ("n", "a", "s"))
    return g.select(topic, "n", F.round((a - s) / 2 / n, 6).alias("left"), F.round((n - a) / n, 6).alias("neutral"), F.round((a + s) / 2 / n, 6).alias("right"))


def agenda_overlap(cells: DataFrame, group: str, a: str, b: str, topic: str = "topic", k: int = 10) -> DataFrame:
    """Per topic the shares of two groups' chunks, their ranks, and whether it is among the k largest of both or one."""
    per = cells.groupBy(topic).agg(*(F.sum(F.when(F.col(group) == g, F.col("y")).otherwise(0)).alias(n) for g, n in ((a, "ya"), (b, "yb"))))
    total = per.agg(F.sum("ya").alias("a"), F.sum("yb").alias("b"))
    ta, tb = total.select("a").scalar(), total.select("b").scalar()
    s = per.select(topic, F.round(F.col("ya").cast("double") / ta, 6).alias("share_a"), F.round(F.col("yb").cast("double") / tb, 6).alias("share_b"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), topic)).cast("bigint")  # noqa: E731  (one row per topic)
    r = s.withColumn("rank_a", rank("share_a")).withColumn("rank_b", rank("share_b"))
    top_a, top_b = F.col("rank_a") <= k, F.col("rank_b") <= k
    return r.withColumn("top", F.when(top_a & top_b, "both").when(top_a, "a").when(top_b, "b").otherwise("none"))
