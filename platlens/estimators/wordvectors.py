"""Skip-gram word vectors with a hierarchical softmax, trained on counted pairs of words instead of running text.

How often two words stand near each other is counted once, in parallel; a round of training costs as much as there are
different pairs, however long the texts are. The model is Word2Vec's: every occurrence pulls a word's vector and the nodes
above its neighbour in a Huffman tree once a round, at a rate that falls to nothing over all rounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from ..plans.lineage import cut

#: Words whose pairs a task counts at a time, and different pairs after which it hands on what it has.
BUFFER, PAIRS = 400_000, 6_000_000
#: Steps of a round; words and nodes, the most frequent ones, whose entries take part in every step.
STEPS, CORE = 40, 1000
#: Other entries take part in one step a round for each so much of weight times rate.
SHARE = 0.5
#: Times that a task looks at entries in a round; with more, tasks train side by side and nodes are averaged after each.
LOOKS = 2_000_000
#: Columns of entries: a word, a node, and the weights left and right below it.
ENTRY = {"a": np.int32, "node": np.int32, "p": np.float32, "q": np.float32}
#: Numbers in a table of words by words that a task makes at a time.
DENSE = 4_000_000


@dataclass
class Tree:
    """A Huffman tree: leaves in the order of a walk, and what part of that order lies left and right below each inner node
    (from, middle, to). Nodes are sorted by falling weight, so that the root is 0."""

    leaves: np.ndarray
    spans: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Tree:
        size = len(counts)
        heap = [(int(n), i) for i, n in enumerate(counts)]
        heapq.heapify(heap)
        below: list[tuple[int, int]] = []
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            below.append((i, j))
            heapq.heappush(heap, (a + b, size + len(below) - 1))
        width = np.ones(size + len(below), dtype=np.int64)
        for k, (i, j) in enumerate(below):
            width[size + k] = width[i] + width[j]
        start, spans = np.zeros(size + len(below), dtype=np.int64), np.zeros((len(below), 3), dtype=np.int64)
        for k in range(len(below) - 1, -1, -1):
            i, j = below[k]
            start[i] = start[size + k]
            start[j] = start[i] + width[i]
            spans[len(below) - 1 - k] = start[i], start[j], start[i] + width[size + k]
        return cls(np.argsort(start[:size]), spans)

    def sides(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the leaves left and right below each node, for rows of sums by word."""
        c = np.zeros((len(x), x.shape[1] + 1), dtype=np.int64)
        np.cumsum(x[:, self.leaves], axis=1, out=c[:, 1:])
        a, m, b = c[:, self.spans[:, 0]], c[:, self.spans[:, 1]], c[:, self.spans[:, 2]]
        return m - a, b - m


def numbered_words(texts: DataFrame, key: str, words: str, least: int) -> tuple[DataFrame, np.ndarray]:
    """(texts with their words as numbers, counts by number): words that occur at least `least` times are numbered by falling
    counts, others are -1. The vocabulary is kept on the driver."""
    n = texts.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = sorted(((r.n, r.w) for r in n.collect()), key=lambda r: (-r[0], r[1]))
    at = {w: i for i, (_, w) in enumerate(rows)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(1).flatten().dictionary_encode()
            ids = np.fromiter((at.get(w, -1) for w in found.dictionary.to_pylist()), dtype=np.int32)
            flat = ids[found.indices.to_numpy(zero_copy_only=False)] if len(ids) else np.zeros(0, dtype=np.int32)
            ends = np.r_[0, np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, words])

    schema = texts.select(key).schema.add(words, ArrayType(IntegerType()))
    return cut(texts.select(key, words).mapInArrow(run, schema)), np.array([n for n, _ in rows], dtype=np.int64)


def near_pairs(texts: list[np.ndarray], size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs low * size + high, weights) of words (numbers below `size`) up to `window` apart; at a distance of 1 a pair
    weighs `window`, at each further word 1 less: the chance of a window of random width, times `window`."""
    gap = np.full(window, -1, dtype=np.int64)
    flat = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
    keys = []
    for d in range(1, window + 1):
        a, b = flat[:-d], flat[d:]
        ok = np.flatnonzero((a | b) >= 0)
        a, b = a[ok], b[ok]
        keys.append((np.minimum(a, b) * size + np.maximum(a, b)) * (window + 1) + window + 1 - d)
    keys = np.concatenate(keys)
    keys.sort()
    return _added(keys // (window + 1), keys % (window + 1))


def _added(pair: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of sorted ones, with their weights added up."""
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, dtype=np.int64)
    return pair[starts], np.add.reduceat(weight, starts) if len(pair) else weight


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pair, weight = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(pair, kind="stable")
    return _added(pair[order], weight[order])


def count_pairs(texts: DataFrame, words: str, size: int, window: int) -> DataFrame:
    """(a, b, x): pairs of an array column of word numbers, both ways round; a pair may come from several tasks. A text is
    taken as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        held, waiting, n = (none, none), [], 0

        def out() -> pa.RecordBatch:
            a, b = held[0] // size, held[0] % size
            other = a != b  # a word beside itself is a pair twice: each is the other's neighbour
            x = np.where(other, held[1], 2 * held[1])
            return pa.RecordBatch.from_arrays([pa.array(np.r_[a, b[other]].astype(np.int32)), pa.array(np.r_[b, a[other]].astype(np.int32)), pa.array(np.r_[x, x[other]])], names=["a", "b", "x"])

        for batch in batches:
            column = batch.column(0)
            flat, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False)
            for t in np.split(flat, np.cumsum(lengths)[:-1]):
                waiting.append(t)
                n += len(t)
                if n >= BUFFER:
                    held, waiting, n = _merged(held, near_pairs(waiting, size, window)), [], 0
                    if len(held[0]) >= PAIRS:
                        yield out()
                        held = (none, none)
        held = _merged(held, near_pairs(waiting, size, window))
        if len(held[0]):
            yield out()

    return texts.select(words).mapInArrow(run, "a int, b int, x bigint")


def tree_entries(pairs: DataFrame, tree: Tree, window: int) -> DataFrame:
    """(a, node, p, q): how much of a word's neighbourhood lies left and right below each node above any of its neighbours."""
    size = len(tree.leaves)
    most = max(1, DENSE // size)

    def entries(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, row = np.unique(a, return_inverse=True)
        for k in range(0, len(own), most):
            of = (row >= k) & (row < k + most)
            rows = min(most, len(own) - k)
            table = np.bincount((row[of] - k) * size + b[of], weights=x[of], minlength=rows * size).reshape(rows, size)
            left, right = tree.sides(table.astype(np.int64))
            i, node = np.nonzero(left + right)
            yield pa.RecordBatch.from_arrays([pa.array(own[k + i].astype(np.int32)), pa.array(node.astype(np.int32)), *(pa.array((s[i, node] / window).astype(np.float32)) for s in (left, right))], names=["a", "node", "p", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held = [np.zeros(0, dtype=np.int64)] * 3, 0
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            parts.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            held += batch.num_rows
            if held >= DENSE:
                a, b, x = (np.concatenate(c) for c in zip(rest, *parts))
                upto = int(np.searchsorted(a, a[-1]))  # rows come sorted; more of the last word may follow
                yield from entries(a[:upto], b[:upto], x[:upto])
                rest, parts, held = [a[upto:], b[upto:], x[upto:]], [], 0
        a, b, x = (np.concatenate(c) for c in zip(rest, *parts))
        yield from entries(a, b, x)

    return pairs.repartition("a").sortWithinPartitions("a").mapInArrow(run, "a int, node int, p float, q float")


def _rise(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sum_rows(out: np.ndarray, more: np.ndarray, i: np.ndarray, x: np.ndarray, h: np.ndarray) -> None:
    """Adds rows x and numbers h to those that the sorted i names."""
    if len(i):
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        out[i[starts]] += np.add.reduceat(x, starts, axis=0)
        more[i[starts]] += np.add.reduceat(h, starts)


def _bound(z: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The least curvature of a parabola that touches the logistic loss at z and lies above it everywhere."""
    flat = np.abs(z) < 1e-3
    return np.where(flat, 0.25, (s - 0.5) / np.where(flat, 1, z))


def train(a: np.ndarray, node: np.ndarray, p: np.ndarray, q: np.ndarray, u: np.ndarray, v: np.ndarray, rounds: list[int], of: int, rate: float, seed: int, total: np.ndarray | None = None) -> None:
    """Rounds of training on entries; changes u (words) and v (nodes). `total` has the weight of each node in all tasks: what
    a task sees stands for as much.

    In each step of a round every vector moves by its gradient times the rate, divided by 1 plus the rate times a bound of its
    curvature: that is the sum of many small steps where they are small, and stays stable where a word is frequent. Entries
    between frequent words and high nodes are in every step with their part of the weight, others in as many as their weight
    asks for, at least in one."""
    order = np.lexsort((node, a))
    a, node, p, q = a[order], node[order], p[order], q[order]
    own = np.bincount(node, weights=p + q, minlength=len(v))
    scale = (np.ones(len(v)) if total is None else np.where(own > 0, total / np.maximum(own, 1e-30), 1)).astype(np.float32)
    rows, cols = min(len(u), CORE), min(len(v), CORE)
    inner = (a < rows) & (node < cols)
    cp, cq = np.zeros((rows, cols), dtype=np.float32), np.zeros((rows, cols), dtype=np.float32)
    cp[a[inner], node[inner]], cq[a[inner], node[inner]] = p[inner] / STEPS, q[inner] / STEPS
    held = np.unique(a[inner])
    cp, cq = cp[held], cq[held]
    ct = cp + cq
    times = np.clip(np.ceil((p + q)[~inner] * (rate / SHARE)), 1, STEPS).astype(np.int64)
    first = np.random.default_rng(seed).integers(0, STEPS, len(times))
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    step = (np.repeat(first, times) + nth * STEPS // np.repeat(times, times)) % STEPS
    order = np.argsort(step.astype(np.uint8), kind="stable")  # words stay sorted within a step
    ends = np.searchsorted(step[order], np.arange(STEPS + 1))
    a, node, p, q = (np.repeat(x[~inner], times)[order] for x in (a, node, p, q))
    n = np.repeat(times, times)[order].astype(np.float32)
    p, q = p / n, q / n
    few = np.uint16 if len(v) < 1 << 16 else np.int32  # numbers of 16 bits are sorted faster
    turns = [np.argsort(node[s:e].astype(few), kind="stable") for s, e in zip(ends, ends[1:])]
    for r in rounds:
        for k in range(STEPS):
            now = rate * max(1e-4, 1 - (r + k / STEPS) / of)
            gu, gv, hu, hv = np.zeros_like(u), np.zeros_like(v), np.zeros(len(u), dtype=np.float32), np.zeros(len(v), dtype=np.float32)
            uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
            z = u[held] @ v[:cols].T
            s = _rise(z)
            g, h = cp - ct * s, ct * _bound(z, s)
            gu[held], gv[:cols] = g @ v[:cols], g.T @ u[held]
            hu[held], hv[:cols] = h @ vv[:cols], h.T @ uu[held]
            i, j, x, y, turn = *(z[ends[k] : ends[k + 1]] for z in (a, node, p, q)), turns[k]
            ui, vj = u[i], v[j]
            z = np.einsum("ij,ij->i", ui, vj)
            s = _rise(z)
            g, h = x - (x + y) * s, (x + y) * _bound(z, s)
            _sum_rows(gu, hu, i, g[:, None] * vj, h * vv[j])
            _sum_rows(gv, hv, j[turn], (g[:, None] * ui)[turn], (h * uu[i])[turn])
            u += now * gu / (1 + now * hu)[:, None]
            v += (now * scale)[:, None] * gv / (1 + now * scale * hv)[:, None]


def _packed(entries: DataFrame) -> DataFrame:
    """Entries with the columns of many rows as the bytes of one, as every round reads them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for b in batches:
            parts.append(b)
            if sum(x.num_rows for x in parts) >= 500_000:
                yield one(parts)
                parts = []
        if sum(x.num_rows for x in parts):
            yield one(parts)

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = ([x.column(k).to_numpy(zero_copy_only=False) for x in parts] for k in ENTRY)
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(c).astype(t).tobytes()]) for c, t in zip(columns, ENTRY.values())], names=list(ENTRY))

    return cut(entries.select(*ENTRY).mapInArrow(run, ", ".join(f"{k} binary" for k in ENTRY)))


def fit_vectors(texts: DataFrame, words: str, counts: np.ndarray, dimensions: int, window: int, rounds: int, rate: float = 0.025, seed: int = 5) -> np.ndarray:
    """Vectors of the words 0, 1 ... that the array column `words` names, sorted by falling counts; -1 names no word and
    is passed over. Of fewer than two words there is nothing to learn: their vectors stay what they were at the start."""
    size = len(counts)
    u = ((np.random.default_rng(seed).random((size, dimensions)) - 0.5) / dimensions).astype(np.float32)
    if size < 2:
        return u
    known = texts.select(F.filter(words, lambda w: w >= 0).alias(words))
    entries = cut(tree_entries(count_pairs(known, words, size, window), Tree.of(counts), window))
    times = F.when((F.col("a") < CORE) & (F.col("node") < CORE), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(STEPS), F.ceil((F.col("p") + F.col("q")) * (rate / SHARE)))))
    total, looks = np.zeros(size - 1), 0
    for r in entries.groupBy("node").agg(F.sum(F.col("p") + F.col("q")).alias("w"), F.sum(times).alias("n")).collect():
        total[r.node], looks = r.w, looks + r.n
    parts = max(1, -(-looks // LOOKS))
    entries = _packed(entries.repartition(parts, "a"))
    v = np.zeros((size - 1, dimensions), dtype=np.float32)
    for turn in [[r] for r in range(rounds)] if parts > 1 else [list(range(rounds))]:

        def run(batches: Iterator[pa.RecordBatch], u=u, v=v, turn=turn) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in b.to_pylist()]
            if not rows:
                return
            a, node, p, q = (np.concatenate([np.frombuffer(r[k], dtype=t) for r in rows]) for k, t in ENTRY.items())
            own, above = u.copy(), v.copy()
            train(a, node, p, q, own, above, turn, rounds, rate, seed, total)
            mine, weight = np.unique(a), np.bincount(node, weights=p + q, minlength=len(v)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (mine.astype(np.int64), own[mine], weight, above * weight[:, None])], names=["own", "u", "weight", "v"])

        u, seen, moved = u.copy(), np.zeros(len(v), dtype=np.float32), np.zeros_like(v)
        for r in entries.mapInArrow(run, "own binary, u binary, weight binary, v binary").collect():
            u[np.frombuffer(r.own, dtype=np.int64)] = np.frombuffer(r.u, dtype=np.float32).reshape(-1, dimensions)
            seen += np.frombuffer(r.weight, dtype=np.float32)
            moved += np.frombuffer(r.v, dtype=np.float32).reshape(-1, dimensions)
        v = np.where(seen[:, None] > 0, moved / np.maximum(seen, 1e-30)[:, None], v)
    return u


def mean_vectors(texts: DataFrame, key: str, words: str, u: np.ndarray) -> DataFrame:
    """key, v: the sum of the vectors of a text's words over the number of all its words, also those without a vector."""
    schema = texts.select(key).schema.add("v", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, lengths = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(b.num_rows), lengths)
            flat, doc = flat[flat >= 0], doc[flat >= 0]
            x = np.stack([np.bincount(doc, weights=c[flat], minlength=b.num_rows) for c in u.T.astype(np.float64)], axis=1) / np.maximum(lengths, 1)[:, None]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), rows], names=[key, "v"])

    return texts.select(key, words).mapInArrow(run, schema)
