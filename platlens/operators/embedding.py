"""Vectors of texts by any encoder, resumable by block, and names of topics by any namer."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import exists


def hashing_encoder(texts: list[str], size: int = 64) -> np.ndarray:
    """Bags of hashed words at length 1: an encoder without a model, for tests and dry runs."""
    out = np.zeros((len(texts), size), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()) or [""]:
            h = zlib.crc32(w.encode())
            out[i, h % size] += 1 if h & 0x10000 else -1
        if not out[i].any():
            out[i, 0] = 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def embed(df: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder, batch: int = 512) -> DataFrame:
    """key and vector (array<float>) of every row with a text that is not blank. Within an Arrow batch texts go to the encoder
    by length, so that its own batches need little padding, and come back in order."""
    kind = dict(df.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = p["t"].to_numpy()
            order = np.argsort([len(t) for t in texts], kind="stable")
            vectors: list = [None] * len(texts)
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                for i, v in zip(own, encoder([texts[i] for i in own])):
                    vectors[i] = np.asarray(v, dtype=np.float32)
            yield pd.DataFrame({"k": p["k"], "vector": vectors})

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and trim(t) <> ''")
    return rows.mapInPandas(run, f"k {kind}, vector array<float>").withColumnRenamed("k", key)


def embed_in_blocks(df: DataFrame, key: str, text: str, path: str, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder, blocks: int = 16) -> DataFrame:
    """The vectors at path, made block by block (by a hash of the key): a run that was stopped goes on with the blocks that
    are not there yet. Each block is written as a whole or not at all."""
    spark = df.sparkSession
    for b in range(blocks):
        at = f"{path}/block={b}"
        if not exists(spark, f"{at}/_SUCCESS"):
            own = df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(blocks)) == b)
            embed(own, key, text, encoder).write.mode("overwrite").parquet(at)
    return spark.read.option("basePath", path).parquet(path).drop("block")


def name_topics(keywords: DataFrame, namer: Callable[[int, list[str], list[str]], str], topic: str = "topic", rounds: int = 3, most: int = 10_000) -> list[tuple]:
    """(topic, name, sha256 of what it was named from) for a table of topic and keywords (array, best first).

    The namer gets the topic, its keywords and the names it must not give. Names that are equal but for case and white space
    collide: in each round the colliding topics, but for the first of each name, are named again with all names taken before
    them; what still collides gets its next keywords added. Topics are few; more than `most` are an error."""
    rows = keywords.select(topic, "keywords").orderBy(topic).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} topics")
    squish = lambda s: " ".join(s.split())
    words = {r[topic]: list(r.keywords) for r in rows}
    names = {t: squish(namer(t, w, [])) for t, w in words.items()}

    def colliding() -> list:
        first: dict[str, int] = {}
        return [t for t in words if first.setdefault(names[t].casefold(), t) != t]

    for _ in range(rounds):
        for t in colliding():
            names[t] = squish(namer(t, words[t], sorted(n for u, n in names.items() if u != t)))
    for t in colliding():
        for w in words[t][1:]:
            names[t] = f"{names[t]} {w}"
            if t not in colliding():
                break
    return [(t, names[t], hashlib.sha256("\x1f".join(words[t]).encode()).hexdigest()) for t in words]


def keyword_arrays(terms: DataFrame, topic: str = "topic", term: str = "token", most: int = 10) -> DataFrame:
    """topic and keywords (array, best first) of a ranked table of terms."""
    w = F.array_sort(F.collect_list(F.struct("rank", F.col(term).alias("w"))))
    return terms.where(F.col("rank") <= most).groupBy(topic).agg(w.alias("s")).select(topic, F.col("s.w").alias("keywords"))


def guided_keywords(terms: DataFrame, vectors: DataFrame, most: int = 5, topic: str = "topic") -> DataFrame:
    """Of a topic's terms (topic, token, n) those whose vectors (token, vector) are most like the mean of all of its terms',
    weighted by n: topic, token, similarity, rank. Means are one row a topic and coordinate."""
    x = terms.join(vectors, "token")
    mean = x.select(topic, "n", F.posexplode("vector").alias("i", "v")).groupBy(topic, "i").agg(F.sum(F.col("n") * F.col("v")).alias("c"))
    centre = mean.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("s")).select(topic, F.col("s.c").alias("centre"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    similarity = F.try_divide(dot(F.col("vector"), F.col("centre")), F.sqrt(dot(F.col("vector"), F.col("vector")) * dot(F.col("centre"), F.col("centre"))))
    scored = x.join(centre, topic).select(topic, "token", F.round(similarity, 6).alias("similarity"))
    w = Window.partitionBy(topic).orderBy(F.desc("similarity"), "token")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
