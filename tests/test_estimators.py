import numpy as np
import pytest
from platlens.estimators.counts import correspondence, fit_counts, fit_poisson, poisson_errors, softmax
from platlens.estimators.joint import fit_joint, fit_two_stage, oriented, sandwich, standard
from platlens.estimators.packed import Packed
from platlens.estimators.stance import fit_stance, fit_stance_ridge

D, T = 150, 6


@pytest.fixture(scope="module")
def truth():
    r = np.random.default_rng(1)
    th = r.normal(size=D)
    return {"theta": (th - th.mean()) / th.std(), "alpha": r.normal(0, 0.2, T), "beta": r.uniform(0.2, 0.5, T), "lam": r.normal(0, 0.4, T), "rho": r.normal(0, 1.0, T)}


@pytest.fixture(scope="module")
def packed(spark, truth):
    r = np.random.default_rng(2)
    rows = []
    for i, th in enumerate(truth["theta"]):
        y = r.multinomial(60, softmax((truth["lam"] + truth["rho"] * th)[None])[0][0])
        for t in range(T):
            if y[t]:
                q = np.clip(truth["alpha"][t] + truth["beta"][t] * th, -1, 1)
                rows.append((f"d{i:03}", t, int(y[t]), int((r.random(y[t]) < (1 + q) / 2).sum() * 2 - y[t]), 1.0))
    rows += [(None, 1, 3, 0, 1.0), ("x", None, 3, 0, 1.0), ("x", 1, 0, 0, 1.0)]
    return Packed.of(spark.createDataFrame(rows, "doc_id string, topic int, y bigint, s bigint, theta double"))


def positions(p):
    return np.array([r.theta for r in p.table.select("doc", "theta").orderBy("doc").collect()])


def test_stance_recovers_and_descends(packed, truth):
    f = fit_stance(packed)
    x = positions(f.packed)
    assert np.corrcoef(x, truth["theta"])[0, 1] > 0.9 and abs(x.mean()) < 1e-9 and abs(x.std() - 1) < 1e-9
    assert all(b <= a + 1e-9 * abs(a) for a, b in zip(f.losses, f.losses[1:])) and f.sigma2 > 0


def test_counts_descend_to_a_flat_gradient(packed):
    placed = fit_stance(packed).packed
    c = fit_counts(placed)
    assert all(b <= a for a, b in zip(c.losses, c.losses[1:]))
    assert abs(c.lam.mean()) < 1e-9 and abs(c.rho.mean()) < 1e-9

    def gradient(b):
        mu, _ = softmax(c.lam + c.rho * b.theta[:, None] + c.kap * (b.theta[:, None] ** 2 - 1))
        return b.by_doc(b.y) @ mu - b.by_item(b.y, T)

    assert np.abs(placed.sums(gradient)).max() < 1.0


@pytest.mark.parametrize("fit", [lambda p: fit_poisson(p, sweeps=8).packed, lambda p: correspondence(p)[0]])
def test_count_scaling(packed, truth, fit):
    x = positions(fit(packed))
    assert abs(np.corrcoef(x, truth["theta"])[0, 1]) > 0.8


def test_correspondence_equals_local_svd(packed):
    cells = packed.table.select("doc", "item", "y").orderBy("doc").collect()
    n = np.zeros((len(cells), T))
    for i, r in enumerate(cells):
        n[i, r["item"]] = r.y
    p = n / n.sum()
    r, c = p.sum(axis=1), p.sum(axis=0)
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    u, v, _ = np.linalg.svd(s, full_matrices=False)
    placed, _, value = correspondence(packed)
    assert value == pytest.approx(v[0], rel=1e-5)
    assert abs(np.corrcoef(positions(placed), u[:, 0] / np.sqrt(r))[0, 1]) > 0.9999


def test_joint(spark, packed, truth):
    j = fit_joint(packed, sweeps=4)
    assert all(b <= a for a, b in zip(j.losses, j.losses[1:]))
    assert abs(standard(j.packed)[0]) < 1e-9 and (j.beta**2).mean() == pytest.approx(1)
    assert abs(j.counts.lam.mean()) < 1e-9 and np.corrcoef(positions(j.packed), truth["theta"])[0, 1] > 0.9
    assert np.corrcoef(j.counts.rho, truth["rho"])[0, 1] > 0.9
    se = sandwich(j)
    assert se.shape == (5, T) and np.isfinite(se).all() and (se[:2] > 0).all()
    bench = spark.createDataFrame([(f"d{i:03}", float(-x)) for i, x in enumerate(truth["theta"])], "doc_id string, benchmark double")
    back = oriented(j, bench)
    assert np.allclose(positions(back.packed), -positions(j.packed)) and np.allclose(back.beta, -j.beta)


def test_two_stage(packed, truth):
    j = fit_two_stage(packed)
    assert j.losses[1] <= j.losses[0] and (j.counts.kap == 0).all() and np.corrcoef(positions(j.packed), truth["theta"])[0, 1] > 0.9


@pytest.mark.parametrize("name", ["joint_fit", "joint_items", "poisson_irt", "wordfish"])
def test_registered_fits_end_by_the_operators_rule(monkeypatch, name):
    import inspect

    from platlens.catalog import estimators as catalog

    asked = {}

    def stop(f):
        def call(*args, **more):
            asked.update(inspect.signature(f).bind(*args, **more).arguments)
            raise StopIteration

        return call

    monkeypatch.setattr(catalog, "_packed", lambda *_: None)
    monkeypatch.setattr(catalog, "_words", lambda *_: None)
    monkeypatch.setattr(catalog, "fit_poisson", stop(catalog.fit_poisson))
    monkeypatch.setattr(catalog.joint_model, "fit_joint", stop(catalog.joint_model.fit_joint))
    with pytest.raises(StopIteration):
        getattr(catalog, name)(None, "")
    assert not {"sweeps", "settle", "tolerance"} & asked.keys()


def test_sums_in_pieces_and_by_tree(packed, monkeypatch):
    from platlens.estimators import packed as module

    f = lambda b: np.r_[b.by_item(b.y, T), b.documents, (b.y**2).sum()]
    want = packed.sums(f)
    spread = Packed(packed.table.repartition(7), packed.items)
    monkeypatch.setattr(module, "CHUNK", 3)
    monkeypatch.setattr(module, "DIRECT", 2)
    assert np.allclose(spread.sums(f), want) and len(want) == T + 2
    assert len(Packed(packed.table.limit(0), packed.items).sums(f)) == 0


def dense(packed):
    rows = packed.table.select("doc", "item", "y", "s").orderBy("doc").collect()
    y, s = np.zeros((len(rows), T)), np.zeros((len(rows), T))
    for i, r in enumerate(rows):
        y[i, r["item"]], s[i, r["item"]] = r.y, r.s
    return y, s


def test_ridge_model_equals_a_dense_one(packed):
    y, s = dense(packed)
    z = np.divide(s, y, out=np.zeros_like(s), where=y > 0)
    th = (y * z).sum(1) / y.sum(1)
    th = (th - th.mean()) / th.std()
    for _ in range(3000):
        lines = [np.linalg.lstsq(np.sqrt(y[:, t : t + 1]) * np.c_[np.ones(len(th)), th], np.sqrt(y[:, t]) * z[:, t], rcond=None)[0] for t in range(T)]
        a, b = np.array(lines).T
        th = (y * b * (z - a)).sum(1) / ((y * b * b).sum(1) + 1)
        th = (th - th.mean()) / th.std()
    f = fit_stance_ridge(packed, sweeps=3000, tolerance=1e-10)
    assert np.allclose(positions(f.packed), th, atol=1e-5) and np.allclose(f.beta, b, atol=1e-5)


def test_poisson_errors_equal_dense_information(packed):
    f = fit_poisson(packed)
    y, _ = dense(packed)
    th = positions(f.packed)
    mu = softmax(f.psi + f.beta * th[:, None])[0] * y.sum(1)[:, None]
    of_docs, of_items = poisson_errors(f)
    for i in (0, 7, 100):
        h = np.array([[mu[i].sum(), mu[i] @ f.beta], [mu[i] @ f.beta, mu[i] @ f.beta**2 + 1]])
        assert positions(of_docs)[i] == pytest.approx(np.sqrt(np.linalg.inv(h)[1, 1]), rel=1e-5)
    for t in range(T):
        h = np.array([[mu[:, t].sum(), mu[:, t] @ th], [mu[:, t] @ th, mu[:, t] @ th**2 + 10]])
        assert of_items[t] == pytest.approx(np.sqrt(np.linalg.inv(h)[1, 1]), rel=1e-5)


def test_curvature_prior_follows_the_scale_of_positions(packed):
    from platlens.estimators.counts import Counts, raw_variance, square_deviation

    placed = fit_stance(packed).packed
    x = positions(placed)
    line = np.c_[np.ones(D), x]
    left = x**2 - line @ np.linalg.lstsq(line, x**2, rcond=None)[0]
    assert square_deviation(placed) == pytest.approx(left.std(), rel=1e-9)
    twice = placed.moved(lambda b: 2 * b.theta)
    c = Counts(np.zeros(T), np.zeros(T), np.zeros(T), tau2=3.0)
    assert raw_variance(placed, c) == pytest.approx(16 * raw_variance(twice, c))


def test_counts_agree_by_blocks_and_together(packed, monkeypatch):
    from platlens.estimators import counts

    placed = fit_stance(packed).packed
    a = fit_counts(placed, tau2=0.5, tolerance=1e-10)
    monkeypatch.setattr(counts, "TOGETHER", 0)
    b = fit_counts(placed, tau2=0.5, tolerance=1e-12, steps=300)
    assert a.losses[-1] == pytest.approx(b.losses[-1], rel=1e-6) and np.allclose(a.rho, b.rho, atol=1e-2) and len(a.losses) < len(b.losses)


def test_orientation_by_parties(spark, packed):
    j = fit_joint(packed, sweeps=2)
    x = positions(j.packed)
    rows = [(f"d{i:03}", float(-v), f"p{k}") for i, v in enumerate(x) for k in [int(np.argsort(np.argsort(x))[i] // 30)]]
    means = {p: np.mean([v for _, v, q in rows if q == p]) for p in {q for _, _, q in rows}}
    bench = spark.createDataFrame([(d, float(means[p]), p) for d, _, p in rows], "doc_id string, benchmark double, party string")
    assert np.allclose(oriented(j, bench, party="party").beta, -j.beta)
    up = bench.withColumn("benchmark", -bench.benchmark)
    assert oriented(j, up, party="party") is j


@pytest.mark.parametrize("fine", [True, False])
def test_positions_by_a_lattice_equal_document_by_document(packed, monkeypatch, fine):
    """No table of documents by items is made, and the fit is the one that such tables give."""
    from platlens.estimators import counts

    asked = []
    sums = Packed.sums
    monkeypatch.setattr(Packed, "sums", lambda p, f, dense=True: asked.append(dense) or sums(p, f, dense))
    if not fine:
        monkeypatch.setattr(counts, "TOGETHER", 0)
    fit = fit_poisson(packed, cap=20.0)
    assert asked and not any(asked)
    monkeypatch.setattr(counts, "NEAR", 0.1)  # has to reach further again and again
    again = fit_poisson(packed, cap=20.0)
    monkeypatch.setattr(counts, "NODES", 0)
    dense = fit_poisson(packed, cap=20.0)
    for f in (fit, again):
        assert np.allclose(positions(f.packed), positions(dense.packed), atol=1e-7) and np.allclose(f.beta, dense.beta, atol=1e-7)
        assert len(f.losses) == len(dense.losses) and np.allclose(f.losses, dense.losses, rtol=1e-9)
