"""Validation metrics over pairs of columns: correlation, agreement, classification, separation.

ANSI mode divides by zero loudly, so every ratio here has a null instead: Pearson's r is the covariance over the product
of deviations, null if either is constant or fewer than three pairs are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, numbered


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def pearson(x: str, y: str) -> Column:
    """Pearson's r of finite pairs as an aggregate."""
    ok = finite(x) & finite(y)
    a, b = (F.when(ok, F.col(c).cast("double")) for c in (x, y))
    return F.when(F.count(F.when(ok, 1)) >= 3, F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))))


def weighted_moments(x: str, y: str, w: str) -> list[Column]:
    """Weighted count, means and second moments, to combine in any order."""
    a, b, v = (F.col(c).cast("double") for c in (x, y, w))
    return [F.sum(v).alias("sw"), F.sum(v * a).alias("sx"), F.sum(v * b).alias("sy"), F.sum(v * a * a).alias("sxx"), F.sum(v * b * b).alias("syy"), F.sum(v * a * b).alias("sxy")]


def weighted_r() -> Column:
    """Weighted correlation from weighted_moments."""
    c = F.col
    cov = c("sxy") / c("sw") - c("sx") * c("sy") / (c("sw") * c("sw"))
    vx, vy = c("sxx") / c("sw") - F.pow(c("sx") / c("sw"), 2), c("syy") / c("sw") - F.pow(c("sy") / c("sw"), 2)
    return F.try_divide(cov, F.nullif(F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0))), F.lit(0.0)))


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Rows with the average rank of their value among all rows; values must be the same whenever they are computed. Ranks come from the counts of distinct values: only those
    are ordered, in range partitions, and no window runs over the rows."""
    n = df.where(finite(value)).groupBy(value).agg(F.count("*").alias("__n"))
    ranks = numbered(n, [value], "__b", "__n").select(value, (F.col("__b") + (F.col("__n") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, value, "left")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho of finite pairs with average ranks for ties. The pairs are kept: computed again, a mean may differ in its
    last digit, and its rank would not be found."""
    pairs = cut(df.where(finite(x) & finite(y)).select(x, y))
    ranked = average_rank(average_rank(pairs, x, "__rx"), y, "__ry")
    return ranked.agg(F.count("*").alias("n"), F.round(pearson("__rx", "__ry"), 6).alias("rho"))


def confusion(df: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """gold by predicted counts with fixed labels in fixed order; absent ones are 0."""
    g = df.where(F.col(gold).isin(labels)).groupBy(gold).pivot(predicted, labels).count().na.fill(0, labels)
    return df.sparkSession.createDataFrame([(x,) for x in labels], f"{gold} string").join(g, gold, "left").na.fill(0, labels)


def class_metrics(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 of every label that occurs as either."""
    c = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)
    rows = c.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("gold"), F.lit(0).cast("bigint").alias("pred"), hit.cast("bigint").alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("gold"), F.col("n").alias("pred"), F.lit(0).cast("bigint").alias("tp")))).alias("r")).select("r.*")
    s = rows.groupBy("label").agg(*(F.sum(x).alias(x) for x in ("gold", "pred", "tp")))
    return s.select("label", F.col("gold").alias("support"), F.round(ratio(F.col("tp"), F.col("pred")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("gold")), 6).alias("recall"), F.round(F.coalesce(ratio(2 * F.col("tp"), F.col("gold") + F.col("pred")), F.lit(0.0)), 6).alias("f1"))


def overall_metrics(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """n, accuracy, balanced accuracy, macro F1 and the multiclass Matthews correlation, in one row."""
    ok = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull())
    c = ok.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    per = c.select(F.explode(F.array(F.struct(F.col("g").alias("k"), F.col("n").alias("t"), F.lit(0.0).alias("q"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0.0).alias("c")), F.struct(F.col("p").alias("k"), F.lit(0.0).alias("t"), F.col("n").alias("q"), F.lit(0.0).alias("c")))).alias("r")).select("r.*")
    k = per.groupBy("k").agg(*(F.sum(x).alias(x) for x in "tqc"))
    s = k.agg(F.sum("t").alias("n"), F.sum("c").alias("c"), F.avg(ratio(F.col("c"), F.col("t"))).alias("bal"), F.avg(F.coalesce(ratio(2 * F.col("c"), F.col("t") + F.col("q")), F.lit(0.0))).alias("f1"), F.sum(F.col("t") * F.col("q")).alias("tq"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("q") * F.col("q")).alias("qq"))
    x = F.col
    mcc = F.try_divide(x("c") * x("n") - x("tq"), F.nullif(F.sqrt(x("n") * x("n") - x("qq")) * F.sqrt(x("n") * x("n") - x("tt")), F.lit(0.0)))
    return s.select(x("n").cast("bigint").alias("n"), F.round(ratio(x("c"), x("n")), 6).alias("accuracy"), F.round("bal", 6).alias("balanced_accuracy"), F.round("f1", 6).alias("macro_f1"), F.round(mcc, 6).alias("mcc"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """label, positives, auc of one against the rest by rank sums; ties count half."""
    ranked = average_rank(df.where(finite(score) & F.col(label).isNotNull()), score, "__r")
    n = ranked.agg(F.count("*").alias("n")).scalar()
    g = ranked.groupBy(label).agg(F.count("*").alias("positives"), F.sum("__r").alias("r"))
    m = F.col("positives").cast("double")
    return g.select(label, "positives", F.round(F.try_divide(F.col("r") - m * (m + 1) / 2, m * (n - m)), 6).alias("auc"))


def threshold_grid(df: DataFrame, gold: str, scores: list[str], labels: list[str], grid: list[float]) -> DataFrame:
    """a, b, mcc of the argmax of scores with offsets a and b on the first two; the best first. The grid is small and
    multiplies columns, not shuffled rows: every point's counts are combined where the rows are."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in grid for b in grid)))
    s = df.where(F.col(gold).isNotNull()).select(gold, *scores, each.alias("o"))
    x = [F.col(scores[0]) + F.col("o.a"), F.col(scores[1]) + F.col("o.b"), *map(F.col, scores[2:])]
    top = F.greatest(*x)
    p = F.coalesce(*(F.when(v == top, F.lit(lab)) for v, lab in zip(x, labels)))
    c = s.groupBy("o", F.col(gold).alias("g"), p.alias("p")).agg(F.count("*").cast("double").alias("n"))
    per = c.select("o", F.explode(F.array(F.struct(F.col("g").alias("k"), F.col("n").alias("t"), F.lit(0.0).alias("q"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0.0).alias("c")), F.struct(F.col("p").alias("k"), F.lit(0.0).alias("t"), F.col("n").alias("q"), F.lit(0.0).alias("c")))).alias("r")).select("o", "r.*")
    k = per.groupBy("o", "k").agg(*(F.sum(v).alias(v) for v in "tqc")).groupBy("o").agg(F.sum("t").alias("n"), F.sum("c").alias("c"), F.sum(F.col("t") * F.col("q")).alias("tq"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("q") * F.col("q")).alias("qq"))
    v = F.col
    mcc = F.try_divide(v("c") * v("n") - v("tq"), F.nullif(F.sqrt(v("n") * v("n") - v("qq")) * F.sqrt(v("n") * v("n") - v("tt")), F.lit(0.0)))
    return k.select("o.a", "o.b", F.round(mcc, 6).alias("mcc"))


def overlap(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Share of a above b's median, of b below a's, and shares on the far side of zero."""
    x = df.where(finite(value))
    ma, mb = (x.where(F.col(group) == g).agg(F.median(value).alias("m")).scalar() for g in (a, b))
    is_a, is_b, v = F.col(group) == a, F.col(group) == b, F.col(value)

    def share(inside: Column, test: Column) -> Column:
        return F.round(ratio(F.count_if(inside & test), F.count_if(inside)), 6)

    return x.select(group, value, ma.alias("ma"), mb.alias("mb")).agg(share(is_a, v > F.col("mb")).alias("a_above_b"), share(is_b, v < F.col("ma")).alias("b_below_a"), share(is_a, v > 0).alias("a_positive"), share(is_b, v < 0).alias("b_negative"))


def best_flag(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows with best: whether the value is the largest of its column."""
    top = df.groupBy(column).agg(F.max(value).alias("__m"))
    return df.join(top, column).withColumn("best", F.col(value) == F.col("__m")).drop("__m")
