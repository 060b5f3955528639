"""Vectors: norms, neighbours, centroids, means, principal components, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Classes whose centroids are sent to every task at most.
MOST_CLASSES = 10_000


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in doubles, inside generated code."""
    x, y = (F.transform(F.col(c) if isinstance(c, str) else c, lambda v: v.cast("double")) for c in (a, b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(v: str) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def mean_unit_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, i, value: the mean over a key's rows of vectors at length 1, coordinate by coordinate."""
    return df.select(key, F.posexplode(unit(vector)).alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("value"))


def nearest_centroid(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, label of the nearest class centroid by cosine (the lowest of equals) and whether it is the row's own.

    Centroids number as many as classes; they are joined as one broadcast row. More than MOST_CLASSES are an error."""
    if df.select(label).distinct().limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    cells = df.select(F.col(label).alias("c"), F.posexplode(unit(vector)).alias("i", "v")).groupBy("c", "i").agg(F.avg("v").alias("v"))
    cents = cells.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select("c", F.col("s.v").alias("v")).withColumn("v", unit("v"))
    table = cents.agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("cs"))
    rows = df.select(F.col(key), F.col(label).alias("own"), unit(vector).alias("u")).join(F.broadcast(table))
    scored = F.transform("cs", lambda c: F.struct(F.round(dot(F.col("u"), c["v"]), 9).alias("s"), F.negative(c["c"]).alias("m")))
    return rows.select(key, F.negative(F.array_max(scored)["m"]).alias("nearest"), "own").withColumn("same", F.col("nearest") == F.col("own"))


def knn(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, tile: int = 4096) -> DataFrame:
    """(query, neighbour, similarity, rank) of the k nearest rows of base by cosine, ties to the smaller key; a row is no
    neighbour of itself. A stated query set against all rows: queries travel in tiles of a bounded size, each task keeps
    its own k best per query, and only those are shuffled."""
    q = queries.select(F.col(key).cast("bigint").alias("q"), F.col(vector).alias("v")).where("q is not null and v is not null")
    parts = q.sparkSession
    out = None
    rows = q.orderBy("q").toLocalIterator(prefetchPartitions=True)
    while True:
        block = [r for _, r in zip(range(tile), rows)]
        if not block:
            break
        ids, m = np.array([r.q for r in block]), _unit_rows(np.array([r.v for r in block], dtype=np.float64))

        def search(batches: Iterator[pa.RecordBatch], ids=ids, m=m) -> Iterator[pa.RecordBatch]:
            best_s, best_k = np.full((len(ids), 0), -2.0), np.zeros((len(ids), 0), dtype=np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                keys = b.column(0).to_numpy(zero_copy_only=False)
                dim = m.shape[1]
                x = _unit_rows(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                s = np.round(m @ x.T, 9)
                s[ids[:, None] == keys[None, :]] = -2.0
                s, kk = np.hstack([best_s, s]), np.hstack([best_k, np.broadcast_to(keys, s.shape)])
                # Similarity and place of the key in one number: a partial sort finds the k best, ties to the smaller key.
                place = np.unique(kk, return_inverse=True)[1].reshape(kk.shape)
                rank = np.rint(s * 1e9).astype(np.int64) * (1 << 31) - place
                order = np.argpartition(-rank, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.argsort(-rank, axis=1)
                best_s, best_k = np.take_along_axis(s, order, 1), np.take_along_axis(kk, order, 1)
            if best_s.shape[1]:
                ok = best_s > -2.0
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(axis=1))), pa.array(best_k[ok]), pa.array(best_s[ok])], names=["query", "neighbour", "similarity"])

        part = base.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v")).where("k is not null and v is not null").mapInArrow(search, "query bigint, neighbour bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return parts.createDataFrame([], "query bigint, neighbour bigint, similarity double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def majority(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """query, label (the commonest among its neighbours, the lowest of equals), votes."""
    n = neighbours.join(labels.select(F.col(key).alias("neighbour"), F.col(label).alias("l")), "neighbour").groupBy("query", "l").agg(F.count("*").alias("votes"))
    return n.groupBy("query").agg(F.max(F.struct("votes", F.negative("l").alias("m"))).alias("s")).select("query", F.negative(F.col("s.m")).alias("label"), F.col("s.votes").alias("votes"))


def softmax(columns: list[str], names: list[str], label: str = "stance") -> list[Column]:
    """Probabilities of logits, shifted by their maximum, and the name of the largest (the first of equals)."""
    top = F.greatest(*columns)
    e = [F.exp(F.col(c) - top) for c in columns]
    total = sum(e[1:], e[0])
    pick = F.coalesce(*(F.when(F.col(c) == top, F.lit(n)) for c, n in zip(columns, names)))
    return [*((x / total).alias(f"p_{n.lower()}") for x, n in zip(e, names)), pick.alias(label)]


def gram(df: DataFrame, vector: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, Gram matrix) of vectors: each task adds up its own matrix, of a size the dimension fixes."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, s, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                g += x.T @ x
                s += x.sum(axis=0)
                n += len(x)
        flat = np.concatenate([[n], s, g.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

    rows = df.select(vector).where(F.col(vector).isNotNull()).mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = np.array([r.v for r in rows]) if rows else np.zeros(1 + dim + dim * dim)
    return int(flat[0]), flat[1 : 1 + dim], flat[1 + dim :].reshape(dim, dim)


def principal_scores(df: DataFrame, key: str, vector: str, dim: int, k: int = 1) -> DataFrame:
    """key, score1..k: coordinates on the first principal axes, each with its largest loading positive."""
    n, s, g = gram(df, vector, dim)
    mean = s / max(n, 1)
    values, axes = np.linalg.eigh(g / max(n, 1) - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(k)])
    scores = [(dot(vector, F.array(*(F.lit(float(v)) for v in axes[:, j]))) - F.lit(float(mean @ axes[:, j]))).alias(f"score{j + 1}") for j in range(k)]
    return df.where(F.col(vector).isNotNull()).select(key, *scores)


def purify(df: DataFrame, key: str, vector: str, topic: str, spread: DataFrame, least: float, k: int = 50) -> DataFrame:
    """key, topic: rows of topics whose keyword spread is below `least` get the topic that most of their k nearest kept rows
    have; others stay. The masked rows are the stated query set, in tiles."""
    weak = spread.where(F.col("spread") < least).select(topic)
    masked = df.join(weak, topic, "left_semi")
    kept = df.join(weak, topic, "left_anti")
    new = majority(knn(masked, kept, key, vector, k), kept, key, topic)
    moved = masked.select(key, topic).join(new.select(F.col("query").alias(key), F.col("label").alias("__new")), key, "left")
    return kept.select(key, topic).unionByName(moved.select(key, F.coalesce("__new", topic).alias(topic)))
