import itertools
import random

import numpy as np
import pytest
from platlens.operators import classify, metrics, relational, sampling, tokens, vectors
from platlens.operators.components import connected_components


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_dedup_and_upsert(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), ("a", 2, "z")], "k string, t int, v string")
    assert sorted(map(tuple, relational.dedup(df, ["k"], ["t"]).collect())) == [("a", 2, "z"), ("b", 1, None)]
    new = spark.createDataFrame([("b", 9)], "k string, t int")
    assert {r.k: r.t for r in relational.upsert(relational.dedup(df, ["k"], ["t"]), new, ["k"]).collect()} == {"a": 2, "b": 9}


def test_validation(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "q")], "k string, v string")
    with pytest.raises(ValueError, match="unique"):
        relational.require(df, key=["k"])
    assert relational.require(df.where("v <> 'y'"), key=["k"], domains={"v": ["x", "q"]}).count() == 2
    assert relational.violations(df, ["k"], {"v": ["x"]}, df.where("k = 'a'")).count() == 4


@pytest.mark.parametrize("seed", range(6))
def test_capped_allocation(spark, seed):
    r = random.Random(seed)
    sizes = [(f"p{i}", r.choice([1, 3, 10, 50, 200])) for i in range(8)]
    total = r.randint(8, 300)
    rows = sampling.capped_allocation(spark.createDataFrame(sizes, "party string, n bigint"), total).collect()
    assert sum(x.seats for x in rows) == min(total, sum(n for _, n in sizes)) and all(x.seats <= x.n for x in rows)
    level = [x.seats for x in rows if x.seats < x.n]
    assert not level or max(level) - min(level) <= 1 and all(x.seats <= max(level) for x in rows)


def test_batches_are_consecutive(spark):
    out = sampling.batches(spark.createDataFrame([(f"k{i:04}",) for i in range(217)], "k string").repartition(7), "k", 50).orderBy("k").collect()
    assert [r.batch for r in out] == [i // 50 for i in range(217)]


def test_classification_resumes(spark):
    df = spark.createDataFrame([(f"k{i:03}", f"text {i}") for i in range(130)] + [("k999", None)], "k string, t string")
    m = classify.manifest(df, "k", "t")
    log = classify.answer(m.where("batch_id = 'r001'"), classify.fake_client, "p")
    broken = spark.createDataFrame([('{"schema_version": 1, "batch_id": "r000", "items": [',), ('{"schema_version": 7, "batch_id": "r002", "items": []}',)], "value string")
    got = classify.read_log(log.unionByName(broken), "p")
    assert [r.batch_id for r in got.collect()] == ["r001"] and len(got.first()["items"]) == 50
    assert sorted(r.batch_id for r in classify.pending(m, got).collect()) == ["r000", "r002"]
    assert classify.read_log(log, "other prompt").count() == 0


def test_guarded_ratios(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None), (1.0, 5.0)], "x double, y double")
    assert df.agg(metrics.pearson("x", "y").alias("r")).first().r is None
    assert metrics.spearman(df, "x", "y").first().rho is None
    assert metrics.overall_metrics(df.selectExpr("'a' g", "'a' p"), "g", "p").first().mcc is None


def test_auc_by_pairs(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), float(r.randrange(6))) for _ in range(80)]
    got = {x.l: x.auc for x in metrics.auc(spark.createDataFrame(rows, "l string, s double"), "l", "s").collect()}
    a, b = [s for k, s in rows if k == "a"], [s for k, s in rows if k == "b"]
    want = sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(a, b)) / (len(a) * len(b))
    assert got["a"] == pytest.approx(want, abs=1e-6)


def test_glue():
    assert tokens.glue("a b c b c".split(), {"a_b", "b_c"}) == ["a_b", "c", "b_c"] and tokens.glue([], {"a_b"}) == []


def test_knn_recall_and_tiles(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(400, [0.0] * 8), (None, [1.0] * 8)], "id bigint, v array<float>")
    got = vectors.knn(df.where("id % 100 = 0"), df, "id", "v", 5, tile=2)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in (0, 100, 200):
        s = u @ u[q]
        s[q] = -9
        assert [r.neighbour for r in got.where(f"query = {q}").orderBy("rank").collect()] == np.argsort(-s)[:5].tolist()
    assert vectors.knn(df.limit(0), df, "id", "v", 5).count() == 0


def test_principal_scores(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 3)) * [5, 1, 0.1]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, v array<double>")
    s = np.array([r.score1 for r in vectors.principal_scores(df, "id", "v", 3).orderBy("id").collect()])
    c = x - x.mean(axis=0)
    w = np.linalg.svd(c, full_matrices=False)[2][0]
    assert abs(np.corrcoef(s, c @ w)[0, 1]) > 0.999999


def test_recalibration_covers_the_whole_grid(spark, sf_dir):
    import math

    import __spark_entry__ as entry
    from platlens.catalog.metrics import _coded, md5_mod
    from pyspark.sql import functions as F

    got = {(r.a, r.b): r.mcc for r in entry.queries()["offset_recalibration"](spark, sf_dir).collect()}
    axis = [round(-0.3 + 0.02 * k, 2) for k in range(31)]
    assert got.keys() == set(itertools.product(axis, axis))
    x = _coded(spark, sf_dir).where("sid is not null and gold is not null").select("gold", *((md5_mod(F.concat("sid", F.lit(c)), 100) / F.lit(100.0)).alias(c) for c in "lnr")).collect()
    for a, b in ((-0.3, 0.3), (0.02, -0.14), (0.0, 0.0)):
        p = ["left" if r.l + a >= max(r.n + b, r.r) else "neutral" if r.n + b >= r.r else "right" for r in x]
        g = [r.gold for r in x]
        n, c = len(x), sum(u == v for u, v in zip(g, p))
        t, q = ([y.count(k) for k in sorted({*g, *p})] for y in (g, p))
        down = math.sqrt(n * n - sum(v * v for v in q)) * math.sqrt(n * n - sum(v * v for v in t))
        assert got[a, b] == pytest.approx((c * n - sum(u * v for u, v in zip(t, q))) / down, abs=2e-6)
