"""Documents that are alike but for small edits, by a Gray-ordered hierarchical index of fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.lineage import broadcast_if_small, cut
from .words import BatchWords, column, mix64, shingle_codes

#: Min-hashes of a document; two bits of each make its fingerprint of WORDS 64-bit words.
MINIMA = 128
WORDS = 2 * MINIMA // 64
CODE = tuple(f"g{i}" for i in range(WORDS))
#: Rows of one index node that a task takes at a time; larger nodes are split over tasks.
BLOCK = 20_000
LEAF = 32
#: Copies of one text beyond this number are linked to their representative instead of to each other, unless the caller asks
#: for all pairs.
COPIES_SPELLED_OUT = 100

_rng = np.random.default_rng(20_240_601)
_A = (_rng.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)[:, None]


def masks_for(threshold: float) -> tuple[int, int]:
    """(masks, minima in each): the longest patterns of which twenty suffice to miss a pair just at the threshold with no
    more than one percent."""
    for rows in (12, 10, 8, 6, 5, 4, 3, 2):
        masks = math.ceil(math.log(0.01) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if masks <= 20 and masks * rows <= MINIMA:
            return masks, rows
    return min(MINIMA, max(20, math.ceil(math.log(0.01) / math.log(1 - threshold)))), 1


def most_different(threshold: float) -> int:
    """Bits in which fingerprints of a pair at the threshold may differ: the mean and 3.2 standard deviations."""
    p = 1 - threshold
    return math.ceil(MINIMA * p + 3.2 * math.sqrt(MINIMA * (1.5 * p - p * p)))


def sketch(codes: np.ndarray) -> np.ndarray:
    """The minima of 128 hash functions over a set of shingle codes."""
    x = (codes >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, (x[i : i + 4096][None, :] * _A + _B).min(axis=1), out=out)
    return out


def fingerprint(minima: np.ndarray) -> list[int]:
    """Two bits of each minimum, as 64-bit words; equal sets have equal ones."""
    two = mix64(minima.astype(np.uint64) + (np.arange(MINIMA, dtype=np.uint64) << np.uint64(32)))
    bits = np.stack([two & np.uint64(1), (two >> np.uint64(1)) & np.uint64(1)], axis=1).astype(np.uint8).ravel()
    return [int(x) for x in np.packbits(bits).view(">u8")]


def gray_rank(code: list[int]) -> list[int]:
    """The place of a code in Gray order, in 64-bit words from the highest."""
    out, odd = [], 0
    for x in code:
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> s
        x ^= 2**64 - 1 if odd else 0
        out.append(x)
        odd = x & 1
    return out


def gray_codes(ranks: np.ndarray) -> np.ndarray:
    """The codes at these places (one a row, in words from the highest) in Gray order."""
    one = np.uint64(1)
    out = ranks ^ (ranks >> one)
    out[:, 1:] ^= (ranks[:, :-1] & one) << np.uint64(63)
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


class _Node:
    """Codes [i, j) in Gray order, with the bit pattern that all of them share."""

    __slots__ = ("i", "j", "kids", "ones", "zeros")

    def __init__(self, codes: np.ndarray, i: int, j: int) -> None:
        self.i, self.j, self.kids = i, j, ()
        if j - i > LEAF:
            k = (i + j) // 2
            self.kids = (_Node(codes, i, k), _Node(codes, k, j))
            self.ones = self.kids[0].ones & self.kids[1].ones
            self.zeros = self.kids[0].zeros & self.kids[1].zeros
        else:
            self.ones = np.bitwise_and.reduce(codes[i:j], axis=0)
            self.zeros = np.bitwise_and.reduce(~codes[i:j], axis=0)


def _apart(a: _Node, b: _Node) -> int:
    """At least so many bits differ between any code of a and any of b."""
    return int(np.bitwise_count((a.ones & b.zeros) | (a.zeros & b.ones)).sum())


def close_pairs(left: np.ndarray, right: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in left, j in right) of codes that differ in at most `most` bits; within left (i < j) if right is None."""
    codes = left if right is None else right
    a, b = _Node(left, 0, len(left)), _Node(codes, 0, len(codes))
    found_i: list[np.ndarray] = []
    found_j: list[np.ndarray] = []
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if right is None and x.i >= y.j or _apart(x, y) > most:
            continue
        if not x.kids and not y.kids:
            d = np.bitwise_count(left[x.i : x.j, None, :] ^ codes[None, y.i : y.j, :]).sum(axis=2)
            i, j = np.nonzero(d <= most)
            i, j = i + x.i, j + y.i
            if right is None:
                i, j = i[i < j], j[i < j]
            found_i.append(i)
            found_j.append(j)
        elif x.kids and (not y.kids or x.j - x.i >= y.j - y.i):
            todo += [(k, y) for k in x.kids]
        else:
            todo += [(x, k) for k in y.kids]
    none = np.empty(0, dtype=np.int64)
    return np.concatenate(found_i or [none]), np.concatenate(found_j or [none])


_FOUND = pa.schema([("ra", pa.int64()), ("rb", pa.int64()), ("key", pa.int64()), ("block", pa.int64()), *((c, pa.int64()) for c in CODE), ("corpus", pa.string()), ("doc", pa.string())])
_FOUND_SQL = "ra bigint, rb bigint, key bigint, block bigint, " + ", ".join(f"{c} bigint" for c in CODE) + ", corpus string, doc string"


def _pairs_batch(ra: np.ndarray, rb: np.ndarray) -> pa.RecordBatch:
    """Pairs with the smaller reference first, each once."""
    p = np.unique(np.stack([np.minimum(ra, rb), np.maximum(ra, rb)], axis=1), axis=0)
    p = p[p[:, 0] != p[:, 1]]
    void, text = pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), *(void,) * (2 + WORDS), text, text], schema=_FOUND)


def _index_search(most: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key, then in Gray order. A node's rows may span batches; beyond BLOCK rows it is handed on in blocks.
        Rows that name a document pass through."""
        held: list[np.ndarray] = []
        key_held, blocks = None, 0

        def hand_on(rows: np.ndarray, block: int) -> pa.RecordBatch:
            text = pa.nulls(len(rows), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(rows[:, -1]), pa.nulls(len(rows), pa.int64()), pa.array(rows[:, 0]), pa.array(np.full(len(rows), block)), *(pa.array(rows[:, 1 + i]) for i in range(WORDS)), text, text], schema=_FOUND)

        def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """All pairs of complete nodes: small ones by offsets over all nodes at once, larger ones by their trees."""
            key, ref = rows[:, 0], rows[:, -1]
            code = gray_codes(np.ascontiguousarray(rows[:, 1:-1]).view(np.uint64))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[starts, len(key)])
            each = np.repeat(size, size)
            mid = (each > 1) & (each <= LEAF)
            out_a, out_b = [], []
            if mid.any():
                k, c, r = key[mid], code[mid], ref[mid]
                for d in range(1, min(LEAF, int(each[mid].max()))):
                    near = np.flatnonzero(k[d:] == k[:-d])
                    if not len(near):
                        break
                    ok = near[np.bitwise_count(c[near + d] ^ c[near]).sum(axis=1) <= most]
                    out_a.append(r[ok])
                    out_b.append(r[ok + d])
            for s, n in zip(starts[size > LEAF], size[size > LEAF]):
                i, j = close_pairs(code[s : s + n], None, most)
                out_a.append(ref[s + i])
                out_b.append(ref[s + j])
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                for c in range(0, len(a), 200_000):
                    yield _pairs_batch(a[c : c + 200_000], b[c : c + 200_000])

        for batch in batches:
            named = batch.column(3 + WORDS).is_valid()
            own = batch.filter(named)
            if len(own):
                void = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([own.column(1 + WORDS), *(void,) * (3 + WORDS), own.column(2 + WORDS), own.column(3 + WORDS)], schema=_FOUND)
            batch = batch.filter(pc.invert(named))
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2 + WORDS)], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            first, last = held[0][0, 0], rows[-1, 0]
            waiting = sum(map(len, held))
            if first == last and waiting < BLOCK and key_held is None:
                continue
            allrows = np.concatenate(held)
            cut_at = int(np.searchsorted(allrows[:, 0], last)) if (np.diff(allrows[:, 0]) >= 0).all() else int(np.flatnonzero(allrows[:, 0] != last)[-1] + 1) if first != last else 0
            done, rest = allrows[:cut_at], allrows[cut_at:]
            if key_held is not None:  # the node that is being handed on goes first
                own = done[done[:, 0] == key_held] if last != key_held else allrows
                if len(own):
                    yield hand_on(own, blocks)
                    blocks += 1
                if last == key_held:
                    held = []
                    continue
                done, key_held = done[done[:, 0] != key_held], None
            if len(done):
                yield from settle(done)
            held = [rest]
            if len(rest) >= BLOCK:
                yield hand_on(rest, 0)
                key_held, blocks, held = int(last), 1, []
        if held:
            allrows = np.concatenate(held)
            if key_held is not None:
                own = allrows[allrows[:, 0] == key_held]
                if len(own):
                    yield hand_on(own, blocks)
                allrows = allrows[allrows[:, 0] != key_held]
            if len(allrows):
                yield from settle(allrows)

    return search


def _split_nodes(rows: DataFrame, most: int) -> DataFrame:
    """Pairs within nodes too large for one task: blocks of Gray order are compared pairwise, each pair of blocks in a
    task of its own, unless their shared patterns already differ in too many bits."""
    one = F.lit(1).cast("bigint")
    before = [None, *CODE[:-1]]
    carried = [F.lit(0).cast("bigint") if p is None else F.shiftleft(F.col(p).bitwiseAND(one), 63) for p in before]
    codes = [F.col(c).bitwiseXOR(F.shiftrightunsigned(c, 1).bitwiseOR(p)).alias(f"c{i}") for i, (c, p) in enumerate(zip(CODE, carried))]
    coded = rows.select("key", "block", F.col("ra").alias("ref"), *codes)
    words = [f"c{i}" for i in range(WORDS)]
    node = coded.groupBy("key", "block").agg(*(F.bit_and(c).alias(c + "1") for c in words), *(F.bit_and(F.bitwise_not(c)).alias(c + "0") for c in words))
    x, y = node.alias("x"), node.alias("y")

    def differ(w: str):
        a, b = F.col(f"x.{w}1").bitwiseAND(F.col(f"y.{w}0")), F.col(f"x.{w}0").bitwiseAND(F.col(f"y.{w}1"))
        return F.bit_count(a.bitwiseOR(b))

    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block"))).where(sum(map(differ, words), F.lit(0)) <= most)
    pairs = pairs.select(F.col("x.key").alias("key"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = F.explode(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side"))))
    sent = pairs.select("key", "i", "j", sides.alias("s")).select("key", "i", "j", "s.block", "s.side").where("side = 0 or i <> j")
    work = sent.join(coded, ["key", "block"]).select("key", "i", "j", "side", *words, "ref")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = rows[rows[:, 3] == 0], rows[rows[:, 3] == 1]
            right = None if rows[0, 1] == rows[0, 2] else np.ascontiguousarray(b[:, 4:-1]).view(np.uint64)
            i, j = close_pairs(np.ascontiguousarray(a[:, 4:-1]).view(np.uint64), right, most)
            yield _pairs_batch(a[i, -1], (a if right is None else b)[j, -1])

        for batch in batches:
            rows = np.ascontiguousarray(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5 + WORDS)], axis=1))
            edges = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            for part in np.split(rows, edges):
                if not len(part):
                    continue
                if held and (held[-1][-1, :3] != part[0, :3]).any():
                    yield from settle(np.ascontiguousarray(np.concatenate(held)))
                    held = []
                held.append(part)
        if held:
            yield from settle(np.ascontiguousarray(np.concatenate(held)))

    return work.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", *words).mapInArrow(compare, _FOUND_SQL).select("ra", "rb")


class _Documents:
    """Documents of a stream of rows sorted by (corpus, doc, n): for each, the sorted distinct shingle codes."""

    def __init__(self, k: int) -> None:
        self.k, self.words_of = k, BatchWords()

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, np.ndarray]]:
        k = self.k
        name, held, last_n = None, np.empty(0, dtype=np.uint64), None
        for b in batches:
            if not b.num_rows:
                continue
            names, texts, first = [], [], []
            now = name
            for c, d, n, t in zip(*(column(b, x) for x in ("corpus", "doc", "n", "t"))):
                if now is None or c != now[1] or d != now[0]:
                    now, last_n = (d, c), None
                    names.append(now)
                    first.append(len(texts))
                elif n is not None and n == last_n:
                    continue  # a row delivered twice
                last_n = n
                texts.append(t)
            codes, at = self.words_of(texts)
            starts = at[np.array(first, dtype=np.int64)]
            if name is not None:  # the document that the batch before ended in goes on, if only for a moment
                codes, starts = np.concatenate([held, codes]), np.r_[0, starts + len(held)]
                names.insert(0, name)
            stops = np.r_[starts[1:], len(codes)]
            runs = shingle_codes(codes, k)
            for (d, c), i, j in zip(names[:-1], starts[:-1], stops[:-1]):
                yield c, d, np.unique(runs[i : max(i, j - k + 1)])
            name, held = names[-1], codes[starts[-1] :].copy()
        if name is not None:
            yield name[1], name[0], np.unique(shingle_codes(held, k))


def _reference(corpus: str, codes: np.ndarray) -> int:
    """One number for all documents of a corpus with these shingles."""
    from xxhash import xxh3_64_intdigest

    return _signed(xxh3_64_intdigest(codes.tobytes(), seed=xxh3_64_intdigest(corpus) & 0xFFFFFFFF))


def _arranged(rows: DataFrame) -> DataFrame:
    return rows.repartition("corpus", "doc").sortWithinPartitions("corpus", "doc", "n")


class NearDuplicates:
    """Near-duplicate documents of a table of their pieces.

    pieces: corpus, doc, n (order within the document), t (text); a document's text is its pieces with a text in the
    order of n, joined by a space. Two documents of one corpus are alike if the sets of their distinct runs of
    `k` words share at least `threshold` of their union.

    1. Pieces are brought together by document and read as a sorted stream. Documents with equal sets get the same
       reference; each task hands on a reference once, so that a group of copies never grows beyond one row a task.
    2. A document's fingerprint has two bits of each of 128 min-hashes. The index has several upper nodes for it: masked
       patterns of some of the minima, which alike documents share. Below a node fingerprints lie in Gray order, in a
       tree whose inner nodes keep the bits that all below share; whole pairs of subtrees are left out as soon as
       their shared bits differ in too many places. Nodes of more than BLOCK rows are split over tasks by block.
    3. The pairs so found are verified on the whole sets, which are built again for the documents in question only.

    Masks and the bound of differing bits are chosen so that a pair just at the threshold is missed with about one
    percent, one well above it practically never; what is found is exact.

    Pieces with a null text, document or corpus are left out, as are documents of fewer than k words. Pieces with equal
    (corpus, doc, n) count once; those with null n follow in no fixed order. An empty table gives no rows.
    """

    def __init__(self, pieces: DataFrame, k: int = 3, threshold: float = 0.6) -> None:
        self.k, self.threshold = k, threshold
        self.pieces = pieces.select("corpus", "doc", "n", "t").where("t is not null and doc is not null and corpus is not null")
        self._index()

    def _index(self) -> None:
        k, (masks, rows) = self.k, masks_for(self.threshold)
        schema = pa.schema([("key", pa.int64()), *((c, pa.int64()) for c in CODE), ("ref", pa.int64()), ("corpus", pa.string()), ("doc", pa.string())])

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            handed: set[int] = set()
            mask_salt = mix64(np.arange(1, masks + 1, dtype=np.uint64))
            keys: list[np.ndarray] = []
            tails: list[tuple[int, ...]] = []
            members: list[tuple[int, str, str]] = []

            def flush() -> Iterator[pa.RecordBatch]:
                if members:
                    void = pa.nulls(len(members), pa.int64())
                    ref, c, d = zip(*members)
                    yield pa.RecordBatch.from_arrays([pa.array(ref, pa.int64()), *(void,) * WORDS, pa.array(ref, pa.int64()), pa.array(c), pa.array(d)], schema=schema)
                if keys:
                    all_keys = np.concatenate(keys).view(np.int64)
                    t = np.repeat(np.array(tails, dtype=np.int64), masks, axis=0)
                    text = pa.nulls(len(all_keys), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(all_keys), *(pa.array(t[:, i]) for i in range(WORDS + 1)), text, text], schema=schema)
                keys.clear()
                tails.clear()
                members.clear()

            for c, d, codes in _Documents(k).of(batches):
                if not len(codes):
                    continue
                ref = _reference(c, codes)
                members.append((ref, c, d))
                if ref not in handed:
                    handed.add(ref)
                    low = sketch(codes)
                    pattern = low[: masks * rows].astype(np.uint64).reshape(masks, rows)
                    key = mask_salt + np.uint64(hash_of(c))
                    for j in range(rows):
                        key = mix64(key ^ pattern[:, j]) + np.uint64(j + 1)
                    keys.append(key)
                    tails.append((*map(_signed, gray_rank(fingerprint(low))), ref))
                if len(members) >= 2000:
                    yield from flush()
            yield from flush()

        found = _arranged(self.pieces).mapInArrow(entries, "key bigint, " + ", ".join(f"{c} bigint" for c in CODE) + ", ref bigint, corpus string, doc string").repartition("key")
        most = most_different(self.threshold)
        # Gray order is that of unsigned words; flipping the first bit gives it to signed ones.
        order = [F.col(c).bitwiseXOR(F.lit(-(2**63)).cast("bigint")) for c in CODE]
        nodes = found.select("key", *CODE, "ref", "corpus", "doc").sortWithinPartitions("key", *order, "ref")
        got = cut(nodes.mapInArrow(_index_search(most), _FOUND_SQL).distinct())
        self.members = got.where("doc is not null").select("corpus", F.col("ra").alias("ref"), "doc")
        pairs = got.where("rb is not null").select("ra", "rb")
        large = got.where("key is not null")
        if large.limit(1).count():
            pairs = pairs.unionByName(_split_nodes(large, most)).distinct()
        self.candidates = pairs

    def links(self) -> DataFrame:
        """Verified pairs of different texts: ra, rb (references, ra < rb), similarity."""
        k, least = self.k, self.threshold
        wanted = self.candidates.select(F.col("ra").alias("ref")).unionByName(self.candidates.select(F.col("rb").alias("ref"))).distinct()
        chosen = self.members.join(wanted, "ref", "left_semi").groupBy("corpus", "ref").agg(F.min("doc").alias("doc"))
        texts = _arranged(self.pieces.join(broadcast_if_small(chosen.select("corpus", "doc")), ["corpus", "doc"], "left_semi"))
        schema = pa.schema([("ref", pa.int64()), ("codes", pa.binary())])

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple[int, bytes]] = []
            held = 0
            for c, _, codes in _Documents(k).of(batches):
                out.append((_reference(c, codes), codes.tobytes()))
                held += len(codes)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*out), schema)], schema=schema)

        built = texts.mapInArrow(sets, "ref bigint, codes binary")
        beside = self.candidates.join(built.select(F.col("ref").alias("ra"), F.col("codes").alias("ca")), "ra").join(built.select(F.col("ref").alias("rb"), F.col("codes").alias("cb")), "rb")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sim = []
                for x, y in zip(column(b, "ca"), column(b, "cb")):
                    p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    sim.append(both / (len(p) + len(q) - both))
                s = np.array(sim)
                ok = pa.array(s >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(s).filter(ok)], names=["ra", "rb", "similarity"])

        return beside.select("ra", "rb", "ca", "cb").mapInArrow(verify, "ra bigint, rb bigint, similarity double")

    def pairs(self, copies: float | None = None) -> DataFrame:
        """corpus, doc_a, doc_b (doc_a < doc_b): all pairs of alike documents; of a text that more than `copies` documents
        have (COPIES_SPELLED_OUT unless given), only the first document, to which its copies are linked. With math.inf all
        pairs of copies come as well."""
        m = self.members
        copies = COPIES_SPELLED_OUT if copies is None else min(copies, 2**62)
        classes = m.groupBy("corpus", "ref").agg(F.count("*").alias("copies"), F.min("doc").alias("first"))
        several = m.join(classes.where("copies > 1"), ["corpus", "ref"])
        few = several.where(F.col("copies") <= copies).select("corpus", "ref", "doc")
        star = several.where((F.col("copies") > copies) & (F.col("doc") > F.col("first"))).select("corpus", F.col("first").alias("doc_a"), F.col("doc").alias("doc_b"))
        equal = few.withColumnRenamed("doc", "doc_a").join(few.withColumnRenamed("doc", "doc_b"), ["corpus", "ref"]).where("doc_a < doc_b").select("corpus", "doc_a", "doc_b")
        links = cut(self.links().select("ra", "rb"))
        linked = links.select(F.col("ra").alias("ref")).unionByName(links.select(F.col("rb").alias("ref"))).distinct()
        own = m.join(linked, "ref", "left_semi").join(classes, ["corpus", "ref"]).where((F.col("copies") <= copies) | (F.col("doc") == F.col("first"))).select("corpus", "ref", "doc")
        crossed = links.join(own.select("corpus", F.col("ref").alias("ra"), F.col("doc").alias("x")), "ra").join(own.select("corpus", F.col("ref").alias("rb"), F.col("doc").alias("y")), ["corpus", "rb"])
        between = crossed.where("x <> y").select("corpus", F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
        return equal.unionByName(star).unionByName(between).distinct()

    def classes(self) -> DataFrame:
        """One row per document: corpus, doc, class (the first document of its group of alike documents), links (the number
        of different texts that its own is alike to) and copies (documents with its text)."""
        links = cut(self.links().select("ra", "rb"))
        both = links.unionByName(links.select(F.col("rb").alias("ra"), F.col("ra").alias("rb")))
        degree = both.groupBy(F.col("ra").alias("ref")).agg(F.count("*").alias("links"))
        groups = connected_components(links, "ra", "rb").select(F.col("node").alias("ref"), F.col("component").alias("group"))
        m = self.members.join(groups, "ref", "left").join(degree, "ref", "left").withColumn("group", F.coalesce("group", "ref"))
        first = m.groupBy("corpus", "group").agg(F.min("doc").alias("class"))
        copies = m.groupBy("corpus", "ref").agg(F.count("*").alias("copies"))
        return m.join(first, ["corpus", "group"]).join(copies, ["corpus", "ref"]).select("corpus", "doc", "class", F.coalesce("links", F.lit(0)).alias("links"), "copies")


def hash_of(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text)


def pieces_of(chunks: DataFrame, corpus: str, doc: str = "doc_id", key: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """Pieces for NearDuplicates of a chunk table whose keys end in #s<n>."""
    n = F.regexp_extract(F.col(key), r"#s(\d+)$", 1)
    return chunks.select(F.lit(corpus).alias("corpus"), F.col(doc).alias("doc"), F.when(n != "", n).cast("bigint").alias("n"), F.col(text).alias("t"))
