"""Keyed upkeep of tables: dedup, upsert, reconciliation, validation, joins with reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup(df: DataFrame, key: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """One row per key: the last (or first) in `order`, ties by all other columns, so that the choice is the same each run.

    A max over structs combines before the shuffle; a window would sort every group.
    """
    rest = [c for c in df.columns if c not in key]
    s = F.struct(*order, *(c for c in rest if c not in order))
    best = df.groupBy(*key).agg((F.max if keep == "last" else F.min)(s).alias("__s"))
    return best.select(*key, *(F.col("__s")[c].alias(c) for c in rest)).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, then the new rows; missing columns become null."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and whether it is in both lists, only in a (missing) or only in b (extra)."""
    x = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("in_a", F.lit(True))
    y = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("in_b", F.lit(True))
    status = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "missing").otherwise("extra")
    return x.join(y, key, "full").select(key, status.alias("status"))


def composite_key(*parts: str) -> Column:
    """Parts joined by | ; a null part is an empty one, so that parts keep their places."""
    return F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))


def key_part(key: str, k: int) -> Column:
    """The k-th part, from 0, of a composite key; null beyond its end."""
    return F.get(F.split(F.col(key), r"\|"), F.lit(k))


def violations(df: DataFrame, key: list[str], domains: dict[str, list[str]] | None = None, covered_by: DataFrame | None = None) -> DataFrame:
    """(rule, value, n): repeated keys, values outside their domain, keys that a reference does not have; no rows if all is well."""
    k = composite_key(*key)
    out = df.groupBy(k.alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("unique").alias("rule"), "value", "n")
    for c, allowed in (domains or {}).items():
        bad = df.where(~F.col(c).isin(allowed) | F.col(c).isNull()).groupBy(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
        out = out.unionByName(bad.select(F.lit(f"domain {c}").alias("rule"), "value", "n"))
    if covered_by is not None:
        lost = df.join(covered_by.select(*key).distinct(), key, "left_anti").groupBy(k.alias("value")).agg(F.count("*").alias("n"))
        out = out.unionByName(lost.select(F.lit("covered").alias("rule"), "value", "n"))
    return out


def require(df: DataFrame, **rules) -> DataFrame:
    """df itself, or a ValueError that names some violations."""
    bad = violations(df, **rules).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.value} ({r.n})" for r in bad))
    return df
