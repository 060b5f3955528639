"""How characteristic a term is of each category of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import broadcast_if_small, cut

#: Records of a document beyond which its terms are combined over many tasks instead of in one.
HOT = 20_000


def terms_column(text: Column, shortest: int = 3) -> Column:
    """Longest runs of letters, without digits, of at least `shortest` letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{shortest},}}"), F.lit(0))


def term_distinctiveness(records: DataFrame, category: str = "topic", doc: str = "doc_id", text: str = "chunk_text", shortest: int = 3) -> DataFrame:
    """One row per category and term that occurs in it: category, term, documents (of the category with the term),
    documents_all (of any category), documents_total, expected, residual, adjusted, weight.

    Correspondence-analysis residuals of the table of categories by terms, counted in documents: residual is observed
    minus expected over the square root of the expectation; adjusted divides it by the root of its variance, which the
    margins of row and column give (null where a margin fills the table). weight is observed times ln(documents_total /
    documents_all), rounded to six digits.

    Plain DataFrame arithmetic. Texts are brought together by document, where the distinct terms of each of its categories, and
    of all of them, are arrays; what is shuffled from there on are counts of (term, category) combined in each task, never
    (term, document) pairs. The margins are the counts of a null term. Documents of more than HOT records do not come to one
    task: their (term, document, category) triples are combined before they are shuffled.

    Records with null category, document or text are left out; documents without a term still count as documents. Equal
    rows and rows of one document count once. An empty table gives no rows. Other columns are ignored.
    """
    base = records.select(F.col(category).alias("c"), F.col(doc).alias("d"), F.col(text).alias("t")).where("c is not null and d is not null and t is not null")
    none = F.lit(None).cast(records.schema[category].dataType)
    hot = base.groupBy("d").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("d")
    some_hot = bool(hot.limit(1).count())
    hot = broadcast_if_small(hot) if some_hot else hot
    margin = F.array(F.lit(None).cast("string"))
    spread = (base.join(hot, "d", "left_anti") if some_hot else base).repartition("d").select("d", "c", F.array_distinct(terms_column(F.col("t"), shortest)).alias("w"))
    of_category = spread.groupBy("d", "c").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("w"))
    of_doc = of_category.groupBy("d").agg(F.collect_list(F.struct("c", "w")).alias("cells"))
    every = F.struct(none.alias("c"), F.array_distinct(F.flatten("cells.w")).alias("w"))
    counts = of_doc.select(F.inline(F.concat("cells", F.array(every)))).select("c", F.explode(F.concat("w", margin)).alias("term")).groupBy("term", "c").agg(F.count("*").alias("n"))
    if some_hot:
        rows = base.join(hot, "d", "left_semi").select("d", "c", F.explode(F.concat(F.array_distinct(terms_column(F.col("t"), shortest)), margin)).alias("term"))
        triples = rows.groupBy("term", "d", "c").agg(F.lit(1).alias("one")).select("term", "d", "c")
        pairs = triples.select("term", "d").distinct().select("term", none.alias("c"))
        counts = counts.unionByName(triples.select("term", "c").unionByName(pairs).groupBy("term", "c").agg(F.count("*").alias("n"))).groupBy("term", "c").agg(F.sum("n").alias("n"))
    held = cut(counts.groupBy("term").agg(F.collect_list(F.struct("c", "n")).alias("cells")))
    of_all = F.filter("cells", lambda x: x.c.isNull())[0].n
    margins = held.where("term is null")
    total = margins.agg(F.max(of_all).alias("n")).first().n or 0
    sizes = margins.select(F.inline("cells")).where("c is not null").select("c", F.col("n").alias("category_documents"))
    cells = held.where("term is not null").select("term", of_all.alias("documents_all"), F.inline("cells")).where("c is not null").withColumnRenamed("n", "documents")
    n, observed = F.col("documents_total").cast("double"), F.col("documents").cast("double")
    row, column = F.col("category_documents").cast("double"), F.col("documents_all").cast("double")
    out = cells.join(broadcast_if_small(sizes), "c").withColumn("documents_total", F.lit(total).cast("bigint")).withColumn("expected", row * column / n)
    variance = (1 - row / n) * (1 - column / n)
    return out.select(
        F.col("c").alias(category), "term", "documents", "documents_all", "documents_total", "expected",
        ((observed - F.col("expected")) / F.sqrt("expected")).alias("residual"),
        F.when(variance > 0, (observed - F.col("expected")) / F.sqrt(F.col("expected") * variance)).alias("adjusted"),
        F.round(observed * F.log(n / column), 6).alias("weight"),
    )


def top_terms(scored: DataFrame, category: str = "topic", by: str = "weight", most: int = 5) -> DataFrame:
    """The `most` best terms of every category by a score; of equal ones the alphabetically first. A top-k report."""
    w = Window.partitionBy(category).orderBy(F.desc(by), F.col("term"))
    return scored.where(F.col(by).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
