"""The joint fit: one position per document from what it talks about and the side it takes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import pearson, spearman
from .counts import Counts, _dispersion, curvature_variance, dirichlet_scale, fit_counts, rates, raw_variance, softmax
from .packed import Batch, Packed
from .stance import StanceFit, _item_lines, _standard, fit_stance

GRID = np.linspace(-4, 4, 33)


@dataclass
class JointFit:
    packed: Packed | None
    alpha: np.ndarray
    beta: np.ndarray
    counts: Counts
    sigma2: float
    godambe: float
    losses: list[float] = field(default_factory=list)


def _parameters(j: JointFit) -> JointFit:
    """The parameters alone, to be sent to the tasks."""
    return replace(j, packed=None)


def _terms(b: Batch, theta: np.ndarray, j: JointFit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of every document at these positions, with its first and a positive second derivative."""
    c, cells = j.counts, b.doc
    n = b.by_doc(b.y)
    scale = _dispersion(n, c.kappa) * j.godambe
    miss = b.s / b.y - j.alpha[b.item] - j.beta[b.item] * theta[cells]
    r = rates(theta, c.lam, c.rho, c.kap)
    mu, lse = softmax(r)
    slope = c.rho + 2 * c.kap * theta[:, None]
    mean = (mu * slope).sum(axis=1)
    loss = b.by_doc(b.y * miss**2) / (2 * j.sigma2) + (n * lse - b.by_doc(b.y * r[cells, b.item])) / scale + theta**2 / 2
    grad = -b.by_doc(b.y * j.beta[b.item] * miss) / j.sigma2 + (n * mean - b.by_doc(b.y * slope[cells, b.item])) / scale + theta
    h = b.by_doc(b.y * j.beta[b.item] ** 2) / j.sigma2 + n * np.maximum((mu * slope**2).sum(axis=1) - mean**2, 0) / scale + 1
    return loss, grad, h


def place(b: Batch, j: JointFit, steps: int = 25) -> np.ndarray:
    """The best position of every document by itself: Newton steps, halved until its own loss falls; a document that
    does not move any more is left, one that gets stuck is looked up on a grid."""
    theta = b.theta.copy()
    loss, grad, h = _terms(b, theta, j)
    for _ in range(steps):
        move = np.where(np.abs(grad) > 1e-8, grad / h, 0.0)
        if not move.any():
            break
        size = np.ones_like(theta)
        for _ in range(12):
            new = theta - size * move
            loss2, grad2, h2 = _terms(b, new, j)
            worse = loss2 > loss + 1e-12 * np.abs(loss)
            if not worse.any():
                break
            size = np.where(worse, size / 2, size)
        better = loss2 <= loss
        theta, loss, grad, h = np.where(better, new, theta), np.where(better, loss2, loss), np.where(better, grad2, grad), np.where(better, h2, h)
        if not better.any() or np.abs(size * move)[better].max(initial=0) < 1e-8:
            break
    stuck = np.abs(grad) > 1e-3 * np.maximum(h, 1)
    if stuck.any():
        for g in GRID:
            trial = np.where(stuck, g, theta)
            l2, _, _ = _terms(b, trial, j)
            take = stuck & (l2 < loss)
            theta, loss = np.where(take, g, theta), np.where(take, l2, loss)
    return theta


def godambe_factor(packed: Packed, c: Counts) -> float:
    """How much more the count score of documents varies than its information says."""

    def f(b: Batch) -> np.ndarray:
        n = b.by_doc(b.y)
        d = _dispersion(n, c.kappa)
        mu, _ = softmax(rates(b.theta, c.lam, c.rho, c.kap))
        slope = c.rho + 2 * c.kap * b.theta[:, None]
        mean = (mu * slope).sum(axis=1)
        u = (b.by_doc(b.y * slope[b.doc, b.item]) - n * mean) / d
        h = n * np.maximum((mu * slope**2).sum(axis=1) - mean**2, 0) / d
        w = b.weight
        return np.array([w.sum(), (w * u).sum(), (w * u * u).sum(), (w * h).sum()])

    w, u, uu, h = packed.sums(f)
    return max(float((uu - u * u / w) / max(h, 1e-12)), 1e-3)


def _identified(j: JointFit, keep: bool = True) -> JointFit:
    """The same fit with mean position 0, slopes of root mean square 1 and centred count parameters."""
    m = j.packed.sums(lambda b: np.array([b.weight.sum(), (b.weight * b.theta).sum()]))
    shift, s = m[1] / m[0], float(np.sqrt((j.beta**2).mean()))
    s = 1 / s if s > 0 else 1.0  # new position = (old - shift) / s
    c = j.counts
    lam = c.lam + c.rho * shift + c.kap * (shift**2 + s**2 - 1)
    rho, kap = s * (c.rho + 2 * c.kap * shift), s**2 * c.kap
    out = Counts(*(x - x.mean() for x in (lam, rho, kap)), c.kappa, c.tau2, c.losses)
    return JointFit(j.packed.moved(lambda b: (b.theta - shift) / s, keep), j.alpha + j.beta * shift, j.beta * s, out, j.sigma2, j.godambe, j.losses)


def objective(packed: Packed, j: JointFit) -> float:
    """The common loss. The prior of curvatures stands on the footing of the counts it regularizes, and at the scale that
    positions have now."""
    p = _parameters(j)
    value = float(packed.sums(lambda b: np.array([(b.weight * _terms(b, b.theta, p)[0]).sum()]))[0])
    tau2 = raw_variance(packed, j.counts)
    return value + (0.0 if np.isinf(tau2) else float((j.counts.kap**2).sum() / (2 * tau2 * j.godambe)))


def _between(old: JointFit, new: JointFit, size: float) -> JointFit:
    """The fit that lies so far on the way from one to the other."""
    p, mix = _parameters(new), lambda a, b: a + size * (b - a)
    c, d = old.counts, new.counts
    counts = Counts(mix(c.lam, d.lam), mix(c.rho, d.rho), mix(c.kap, d.kap), d.kappa, d.tau2, d.losses)
    moved = old.packed.moved(lambda b: b.theta + size * (place(b, p) - b.theta))
    return JointFit(moved, mix(old.alpha, new.alpha), mix(old.beta, new.beta), counts, new.sigma2, new.godambe, new.losses)


def fit_joint(packed: Packed, sweeps: int = 30, calibrated: bool = True, settle: float = 0.005, stance: StanceFit | None = None, halvings: int = 20) -> JointFit:
    """Staged: stance positions first; at them the counts with their dispersion, curvature variance and the factor by which
    they are discounted, which then stay fixed; then sweeps of stance lines, count parameters and positions. A sweep that,
    identified anew, would raise the common loss is halved as a whole until it does not, and the fit ends where no part of it
    helps. It also ends when two sweeps in a row add less than `settle` of what all have gained."""
    first = stance or fit_stance(packed)
    c = fit_counts(first.packed)
    c.kappa = dirichlet_scale(first.packed, c)
    c = curvature_variance(first.packed, c)
    factor = godambe_factor(first.packed, c) if calibrated else 1.0
    j = _identified(JointFit(first.packed, first.alpha, first.beta, c, max(first.sigma2, 1e-6), factor))
    t = len(packed.items)
    j.losses = [objective(j.packed, j)]
    calm, gained = 0, 0.0
    for sweep in range(sweeps):
        m = j.packed.sums(lambda b: np.concatenate([b.by_item(x, t) for x in (lambda w, th, s: (w, w * th, w * th * th, w * s, w * th * s))(b.weight[b.doc] * b.y, b.theta[b.doc], b.s / b.y)])).reshape(5, t)
        alpha, beta = _item_lines(m)
        counts = fit_counts(j.packed, j.counts, raw_variance(j.packed, j.counts), steps=1)
        counts.kappa, counts.tau2 = j.counts.kappa, j.counts.tau2
        target = JointFit(j.packed, alpha, beta, counts, j.sigma2, j.godambe, j.losses)
        size, allowed = 1.0, j.losses[-1] + 1e-12 * (1 + abs(j.losses[-1]))
        for _ in range(halvings + 1):
            k = _identified(_between(j, target, size))
            loss = objective(k.packed, k)
            if np.isfinite(loss) and loss <= allowed:
                break
            size /= 2
        else:
            break
        gain = max(0.0, j.losses[-1] - loss)
        gained += gain
        k.losses = [*j.losses, loss]
        j = k
        calm = calm + 1 if sweep and gain <= settle * max(1.0, gained) else 0
        if calm >= 2:
            break
    return j


def fit_two_stage(packed: Packed) -> JointFit:
    """The linear variant in stages: stance, then counts without curvature at frozen positions, then positions by both."""
    first = fit_stance(packed)
    c = fit_counts(first.packed, curved=False)
    c.kappa = dirichlet_scale(first.packed, c)
    j = JointFit(first.packed, first.alpha, first.beta, c, max(first.sigma2, 1e-6), 1.0)
    p = _parameters(j)
    j.packed = first.packed.moved(lambda b: place(b, p))
    j.losses = [objective(first.packed, j), objective(j.packed, j)]
    return j


def sandwich(j: JointFit) -> np.ndarray:
    """Robust standard errors of (alpha, beta, lambda, rho, kappa) per topic, positions profiled out: bread from working
    curvature, meat from document scores. Tasks add up 5T x 5T matrices; nothing of a document's size is kept."""
    t = len(j.alpha)
    if t > 600:
        raise ValueError("standard errors are for at most 600 topics")
    packed, j = j.packed, _parameters(j)
    c = j.counts

    def f(b: Batch) -> np.ndarray:
        n, th = b.by_doc(b.y), b.theta
        d = _dispersion(n, c.kappa) * j.godambe
        mu, _ = softmax(rates(th, c.lam, c.rho, c.kap))
        x = np.stack([np.ones_like(th), th, th**2 - 1])
        y = np.zeros((b.documents, t))
        np.add.at(y, (b.doc, b.item), b.y)
        miss = np.zeros((b.documents, t))
        np.add.at(miss, (b.doc, b.item), b.s - b.y * (j.alpha[b.item] + j.beta[b.item] * th[b.doc]))
        left = (y - n[:, None] * mu) / d[:, None]
        score = np.concatenate([miss / j.sigma2, miss * th[:, None] / j.sigma2, *(left * x[k][:, None] for k in range(3))], axis=1)
        slope = c.rho + 2 * c.kap * th[:, None]
        mean = (mu * slope).sum(axis=1)
        _, g, h = _terms(b, th, j)
        # Cross information of items and the document's position.
        cross = np.concatenate([y * j.beta / j.sigma2, y * j.beta * th[:, None] / j.sigma2, *((n / d)[:, None] * mu * (slope - mean[:, None]) * x[k][:, None] for k in range(3))], axis=1)
        w = b.weight
        u = score + cross * (g / h)[:, None]
        meat = (u * (w**2)[:, None]).T @ u
        bread = -(cross * (w / h)[:, None]).T @ cross
        for k, lot in enumerate((np.ones_like(th), th)):
            for l, lot2 in enumerate((np.ones_like(th), th)):
                bread[k * t : (k + 1) * t, l * t : (l + 1) * t] += np.diag((w * lot * lot2) @ y) / j.sigma2
        for k in range(3):
            for l in range(3):
                q = w * n / d * x[k] * x[l]
                bread[(2 + k) * t : (3 + k) * t, (2 + l) * t : (3 + l) * t] += np.diag(q @ mu) - (mu * q[:, None]).T @ mu
        return np.concatenate([bread.ravel(), meat.ravel()])

    m = packed.sums(f)
    bread, meat = m[: 25 * t * t].reshape(5 * t, 5 * t), m[25 * t * t :].reshape(5 * t, 5 * t)
    tau2 = raw_variance(packed, c)
    if not np.isinf(tau2):
        bread[4 * t :, 4 * t :] += np.eye(t) / (tau2 * j.godambe)
    inverse = np.linalg.pinv(bread, rcond=1e-10, hermitian=True)
    return np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0)).reshape(5, t)


def oriented(j: JointFit, benchmark: DataFrame, doc: str = "doc_id", value: str = "benchmark", party: str | None = None) -> JointFit:
    """The fit reflected, if its positions correlate negatively with a benchmark of documents; with `party`, a column of the
    benchmark, if mean positions of parties have a negative rank correlation with the parties' values (the first of each)."""
    p = j.packed.table.select(F.col("doc").alias(doc), "theta").join(benchmark.select(doc, F.col(value).cast("double").alias("v"), *([F.col(party).alias("g")] if party else [])), doc).where("v is not null and not isnan(v)")
    if party:
        groups = p.where("g is not null").groupBy("g").agg(F.avg("theta").alias("theta"), F.min("v").alias("v"))
        r = spearman(groups, "theta", "v").first().rho
    else:
        r = p.agg(pearson("theta", "v").alias("r")).first().r
    if r is None or r >= 0:
        return j
    c = j.counts
    return JointFit(j.packed.moved(lambda b: -b.theta), j.alpha, -j.beta, Counts(c.lam, -c.rho, c.kap, c.kappa, c.tau2, c.losses), j.sigma2, j.godambe, j.losses)


def document_intercepts(j: JointFit) -> Packed:
    """The profiled intercept of every document: log of its count less the log of the sum of its topics' rates."""
    c = j.counts
    return j.packed.moved(lambda b: np.log(b.by_doc(b.y)) - softmax(rates(b.theta, c.lam, c.rho, c.kap))[1])


def fit_grid(tables: dict[str, Packed], variants: dict[str, bool] | None = None) -> dict[tuple[str, str], JointFit]:
    """Joint fits of several tables (levels of topics), with and without the discount of counts."""
    variants = variants or {"calibrated": True, "plain": False}
    stances = {level: fit_stance(packed) for level, packed in tables.items()}
    return {(level, name): fit_joint(packed, calibrated=on, stance=stances[level]) for level, packed in tables.items() for name, on in variants.items()}


def standard(packed: Packed) -> tuple[float, float]:
    """Mean and deviation of positions."""
    return _standard(*packed.sums(lambda b: np.array([b.documents, b.theta.sum(), (b.theta**2).sum()])))
