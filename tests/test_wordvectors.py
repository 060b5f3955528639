import numpy as np
import pytest
from platlens.estimators import wordvectors as wv

COUNTS = np.array([40, 22, 15, 9, 9, 4, 2])


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(3)
    return [r.choice(7, size=n, p=COUNTS / COUNTS.sum()).astype(np.int64) for n in (30, 1, 0, 17, 60)]


def brute_pairs(texts, window):
    x = np.zeros((7, 7), dtype=int)
    for t in texts:
        for i in range(len(t)):
            for j in range(max(0, i - window), min(len(t), i + window + 1)):
                if i != j:
                    x[t[i], t[j]] += window + 1 - abs(i - j)
    return x


def brute_sides(x):
    """By the path of each leaf in a Huffman tree of sets."""
    heap = [(int(n), i, [i]) for i, n in enumerate(COUNTS)]
    nodes = []
    while len(heap) > 1:
        heap.sort(key=lambda h: h[:2])
        a, b, *heap = heap
        nodes.append((a[2], b[2]))
        heap.append((a[0] + b[0], 6 + len(nodes), a[2] + b[2]))
    return np.array([[x[:, s].sum(axis=1) for s in n] for n in nodes[::-1]]).transpose(1, 2, 0)


def test_pairs_and_sides_equal_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(wv, "BUFFER", 20)
    monkeypatch.setattr(wv, "PAIRS", 5)
    monkeypatch.setattr(wv, "DENSE", 14)
    df = spark.createDataFrame([(t.tolist(),) for t in texts], "w array<int>")
    pairs = wv.count_pairs(df, "w", 7, 4)
    x = np.zeros((7, 7), dtype=int)
    for r in pairs.collect():
        x[r.a, r.b] += r.x
    assert (x == brute_pairs(texts, 4)).all()
    got = np.zeros((2, 7, 6))
    rows = wv.tree_entries(pairs, wv.Tree.of(COUNTS), 4).collect()
    for r in rows:
        got[:, r.a, r.node] += (r.p, r.q)
    assert np.allclose(got * 4, brute_sides(x)) and len({(r.a, r.node) for r in rows}) == len(rows)


def loss(x, p, q, u, v):
    s = u @ v.T
    return (p * np.logaddexp(0, -s) + q * np.logaddexp(0, s)).sum() / x.sum()


@pytest.mark.parametrize("core", [1000, 2, 0])
def test_training_follows_single_steps(texts, monkeypatch, core):
    """The loss of word by word training with the same rate and rounds is met, whatever takes part in every step."""
    x = brute_pairs(texts * 40, 4) / 4
    p, q = brute_sides(x)[0], brute_sides(x)[1]
    monkeypatch.setattr(wv, "CORE", core)
    r = np.random.default_rng(0)
    u, v = ((r.random((7, 8)) - 0.5) / 8).astype(np.float32), np.zeros((6, 8), dtype=np.float32)
    a, b = u.astype(float), v.astype(float)
    i, n = np.nonzero(p + q)
    wv.train(i, n, p[i, n].astype(np.float32), q[i, n].astype(np.float32), u, v, list(range(15)), 15, 0.025, 5)
    for k in range(15 * 400):  # as many small steps as single ones come near to
        rate = 0.025 * (1 - k / 6000) / 400
        g = p - (p + q) / (1 + np.exp(-a @ b.T))
        a, b = a + rate * g @ b, b + rate * g.T @ a
    first = loss(x, p, q, np.zeros((7, 8)), v)
    assert abs(loss(x, p, q, u, v) - loss(x, p, q, a, b)) < 0.1 * (first - loss(x, p, q, a, b))


def test_entries_in_parts_and_few_words(spark, texts, monkeypatch):
    df = spark.createDataFrame([(f"d{i}", t.tolist() + [-1]) for i, t in enumerate(texts)], "d string, w array<int>")
    one = wv.fit_vectors(df, "w", COUNTS, 4, 3, 15)
    monkeypatch.setattr(wv, "CORE", 0)
    monkeypatch.setattr(wv, "LOOKS", 20)
    parts = wv.fit_vectors(df, "w", COUNTS, 4, 3, 15)
    assert one.shape == parts.shape == (7, 4) and np.isfinite(parts).all() and not np.allclose(one, parts)
    assert wv.fit_vectors(df, "w", COUNTS[:1], 4, 3, 15).shape == (1, 4) and wv.fit_vectors(df, "w", COUNTS[:0], 4, 3, 15).shape == (0, 4)
    got = {r.d: r.v for r in wv.mean_vectors(df, "d", "w", one).collect()}
    assert np.allclose(got["d3"], one[texts[3]].sum(axis=0) / 18, atol=1e-6) and np.allclose(got["d2"], 0)


def test_query_does_not_walk_the_texts_in_one_task(spark, sf_dir, monkeypatch):
    from platlens.catalog.estimators import word_embedding_positions
    from platlens.catalog.tokens import token_stream
    from pyspark.ml.feature import Word2Vec

    def walk(*_):
        raise AssertionError("all texts in one partition, fifteen times")

    monkeypatch.setattr(Word2Vec, "_fit", walk)
    rows = word_embedding_positions(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in token_stream(spark, sf_dir).collect()} and np.isfinite([r.score1 for r in rows]).all()
