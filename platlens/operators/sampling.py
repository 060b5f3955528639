"""Samples, splits and batches in an order that hashing fixes: the same at every run, partitioning and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import broadcast_if_small, numbered


def hash_order(key: str, seed: str = "") -> Column:
    """A random-looking order that other engines can reproduce."""
    return F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))


def per_stratum(df: DataFrame, strata: list[str], key: str, k: int, seed: str = "") -> DataFrame:
    """At most k rows per stratum. Catalyst turns row_number <= k into a top-k per partition before the shuffle."""
    w = Window.partitionBy(*strata).orderBy(hash_order(key, seed), key)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def uniform(df: DataFrame, key: str, k: int, seed: str = "") -> DataFrame:
    """k rows without replacement."""
    return df.orderBy(hash_order(key, seed), key).limit(k)


def oversample(df: DataFrame, cls: str, key: str) -> DataFrame:
    """Every class repeated until it has as many rows as the largest; copy says which repetition a row is. Places within a
    class follow from places in the order of class and key, so that no class has to fit one task."""
    n = df.groupBy(cls).agg(F.count("*").alias("__n"))
    sizes = n.withColumn("__first", F.sum("__n").over(Window.orderBy(cls)) - F.col("__n"))  # one row a class
    most = n.agg(F.max("__n").alias("m")).scalar()
    ranked = numbered(df, [cls, key], "__r").join(broadcast_if_small(sizes), cls).withColumn("__r", F.col("__r") - F.col("__first"))
    copies = F.floor((most - 1 - F.col("__r")) / F.col("__n")).cast("int")
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).drop("__n", "__r", "__first")


def group_split(df: DataFrame, group: str, train: int = 70, validation: int = 15, seed: str = "split") -> DataFrame:
    """split: train, validation or test, by a hash of the group; groups are never divided, shares are approximate."""
    h = hash_order(group, seed)
    # Two characters of the hash give 0..255.
    code = lambda c: F.when(c >= F.ascii(F.lit("a")), c - 87).otherwise(c - 48)
    b = (code(F.ascii(F.substring(h, 1, 1))) * 16 + code(F.ascii(F.substring(h, 2, 1)))) * 100
    return df.withColumn("split", F.when(b < 256 * train, "train").when(b < 256 * (train + validation), "validation").otherwise("test"))


def capped_allocation(sizes: DataFrame, total: int, name: str = "party", n: str = "n") -> DataFrame:
    """Equal shares of `total` that no group's size exceeds: groups smaller than the common level give all they have, the
    rest of the division goes one each to the first groups in name order. Closed form over sorted sizes; one small table."""
    w = Window.orderBy(n, name)
    k = F.count("*").over(Window.partitionBy())
    s = sizes.withColumn("__before", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__i", F.row_number().over(w)).withColumn("__left", k - F.col("__i") + 1)
    s = s.withColumn("__level", F.floor((F.lit(total) - F.col("__before")) / F.col("__left")))
    s = s.withColumn("__all", F.col(n) <= F.col("__level"))
    done = s.agg(F.coalesce(F.sum(F.when(F.col("__all"), F.col(n))), F.lit(0)).alias("given"), F.count_if(~F.col("__all")).alias("open"))
    given, still = done.select("given").scalar(), done.select("open").scalar()
    level = F.floor((F.lit(total) - given) / F.greatest(still, F.lit(1)))
    extra = (F.lit(total) - given) - level * still
    place = F.row_number().over(Window.partitionBy("__all").orderBy(name))
    return s.select(name, n, F.when(F.col("__all"), F.col(n)).otherwise(level + (place <= extra).cast("bigint")).cast("bigint").alias("seats"))


def batches(df: DataFrame, key: str, size: int = 50) -> DataFrame:
    """Rows with batch, of `size` consecutive keys each."""
    return numbered(df, [key], "__r").withColumn("batch", F.floor(F.col("__r") / size)).drop("__r")
