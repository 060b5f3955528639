import itertools
import math
import random

import numpy as np
import pytest
from platlens.llm import neardup
from platlens.llm.neardup import NearDuplicates, close_pairs, fingerprint, gray_codes, gray_rank, masks_for, pieces_of, sketch

VOCABULARY = [f"w{i}" for i in range(4000)]


def documents(seed=1, groups=40, size=4, words=120):
    r = random.Random(seed)
    docs = {}
    for g in range(groups):
        base = [r.choice(VOCABULARY) for _ in range(words)]
        for k in range(size):
            own = list(base)
            for _ in range(r.randint(0, 9)):
                own[r.randrange(len(own))] = r.choice(VOCABULARY)
            docs[f"g{g:03}_{k}"] = own
    return docs


def similar(docs, k=3, least=0.6):
    sets = {d: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for d, w in docs.items()}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def pieces(spark, docs, corpus="us"):
    rows = [(corpus, d, i, " ".join(w[j : j + 25]), "extra") for d, w in docs.items() for i, j in enumerate(range(0, len(w), 25))]
    return spark.createDataFrame(rows, "corpus string, doc string, n bigint, t string, ref string")


def test_gray_order_and_tree():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, (20, 4), dtype=np.uint64)
    codes = np.repeat(base, 30, axis=0) ^ (np.uint64(1) << r.integers(0, 64, (600, 4), dtype=np.uint64))
    ranks = [gray_rank([int(x) for x in c]) for c in codes]
    assert (gray_codes(np.array(ranks, dtype=np.uint64)) == codes).all()
    step = [gray_rank([0, 0, 0, x]) for x in (0, 1, 3, 2)]
    assert [s[3] for s in step] == [0, 1, 2, 3]
    order = sorted(range(600), key=lambda i: ranks[i])
    c = codes[order]
    i, j = close_pairs(c, None, 20)
    d = np.bitwise_count(c[:, None] ^ c[None]).sum(axis=2)
    assert set(zip(i, j)) == {(a, b) for a, b in zip(*np.nonzero(d <= 20)) if a < b}
    i, j = close_pairs(c[:100], c[100:], 20)
    assert set(zip(i, j)) == set(zip(*np.nonzero(d[:100, 100:] <= 20)))


def test_sketch_estimates_similarity():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.r_[a[:1500], r.integers(0, 2**63, 500, dtype=np.uint64)]
    assert abs((sketch(a) == sketch(b)).mean() - 0.6) < 0.15 and len(fingerprint(sketch(a))) == 4
    masks, rows = masks_for(0.6)
    assert 1 - (1 - 0.6**rows) ** masks >= 0.99 and masks_for(0.8)[1] > rows


def test_recall_against_brute_force(spark):
    docs = documents()
    got = {(r.doc_a, r.doc_b) for r in NearDuplicates(pieces(spark, docs)).pairs().collect()}
    want = similar(docs)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 100


def test_hot_node_is_split_and_loses_nothing(spark, monkeypatch):
    docs = documents(2, groups=1, size=220, words=60)
    one = {(r.doc_a, r.doc_b) for r in NearDuplicates(pieces(spark, docs)).pairs().collect()}
    monkeypatch.setattr(neardup, "BLOCK", 40)
    two = {(r.doc_a, r.doc_b) for r in NearDuplicates(pieces(spark, docs)).pairs().collect()}
    assert one == two and len(one) > 1000


def test_copies_nulls_and_corpora(spark, monkeypatch):
    docs = {f"c{i:03}": VOCABULARY[:50] for i in range(12)} | {"x": ["a", "b"], "y": ["a", "b"]}
    p = pieces(spark, docs).unionByName(pieces(spark, docs)).unionByName(pieces(spark, {"c000": VOCABULARY[:50]}, "br"))
    p = p.unionByName(spark.createDataFrame([("us", None, 0, "a b c d", ""), ("us", "c000", 9, None, ""), (None, "q", 0, "a b c", "")], p.schema))
    assert NearDuplicates(p).pairs().count() == 12 * 11 / 2
    monkeypatch.setattr(neardup, "COPIES_SPELLED_OUT", 5)
    n = NearDuplicates(p)
    assert {(r.doc_a, r.doc_b) for r in n.pairs().collect()} == {("c000", f"c{i:03}") for i in range(1, 12)}
    c = {(r.corpus, r.doc): r for r in n.classes().collect()}
    assert len(c) == 13 and c["us", "c007"]["class"] == "c000" and c["us", "c007"].copies == 12 and c["us", "c007"].links == 0


def test_classes_follow_links(spark):
    docs = documents(5, groups=6, size=3)
    got = {r.doc: r["class"] for r in NearDuplicates(pieces(spark, docs)).classes().collect()}
    for a, b in similar(docs):
        assert got[a] == got[b]
    assert set(got) == set(docs)


@pytest.mark.parametrize("rows", [[], [("us", "d", 0, "")]])
def test_empty(spark, rows):
    n = NearDuplicates(spark.createDataFrame(rows, "corpus string, doc string, n bigint, t string"))
    assert n.pairs().count() == 0 and n.classes().count() == 0


def test_documents_across_batches_and_very_long_ones(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = documents(7, groups=3, size=3) | {"long1": VOCABULARY * 30, "long2": [*VOCABULARY * 30, "more"]}
        got = {(r.doc_a, r.doc_b) for r in NearDuplicates(pieces(spark, docs)).pairs().collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == similar(docs)


def test_pieces_take_their_order_from_the_key(spark):
    df = spark.createDataFrame([("d#s10", "d", "b"), ("d#s2", "d", "a"), ("odd", "d", "c")], "chunk_id string, doc_id string, chunk_text string")
    assert sorted((r.n is None, r.n, r.t) for r in pieces_of(df, "us").collect() if r.n is not None) == [(False, 2, "a"), (False, 10, "b")]


def test_all_pairs_of_copies_on_request(spark):
    docs = {f"c{i:02}": [f"v{j}" for j in range(30)] for i in range(12)}
    n = NearDuplicates(pieces(spark, docs))
    star = {(r.doc_a, r.doc_b) for r in n.pairs(copies=5).collect()}
    assert star == {("c00", d) for d in docs if d != "c00"}
    assert {(r.doc_a, r.doc_b) for r in n.pairs(copies=math.inf).collect()} == set(itertools.combinations(sorted(docs), 2))
