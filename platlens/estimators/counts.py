"""Count models on document positions: multinomial salience with profiled intercepts, and Poisson scaling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

from .packed import DENSE, Batch, Packed
from .stance import EPS, _standard


def rates(theta: np.ndarray, lam: np.ndarray, rho: np.ndarray, kap: np.ndarray) -> np.ndarray:
    return lam + rho * theta[:, None] + kap * (theta[:, None] ** 2 - 1)


def softmax(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, log of the sum of exponentials) by row."""
    top = r.max(axis=1, keepdims=True)
    e = np.exp(r - top)
    z = e.sum(axis=1, keepdims=True)
    return e / z, (top + np.log(z))[:, 0]


def _dispersion(n: np.ndarray, kappa: float) -> np.ndarray:
    return np.ones_like(n) if np.isinf(kappa) else np.maximum((n + kappa) / (1 + kappa), 1.0)


@dataclass
class Counts:
    lam: np.ndarray
    rho: np.ndarray
    kap: np.ndarray
    kappa: float = np.inf
    #: Variance of curvatures at positions whose squares have deviation 1 around their line (see raw_variance).
    tau2: float = np.inf
    losses: list[float] = field(default_factory=list)


def _centred(x: np.ndarray) -> np.ndarray:
    return x - x.mean(axis=-1, keepdims=True)


#: Item parameters up to which Newton steps use the information of all items together; beyond, that of each item by itself.
TOGETHER = 1500


def _information(x: np.ndarray, w: np.ndarray, mu: np.ndarray, together: bool) -> np.ndarray:
    """Information of the parameters (one set x of regressors for all items) that multinomials with probabilities mu and
    weights w give, flat: (k, l, t, u) for all items together, else (k, l, t), which bounds it from above."""
    k, t = len(x), mu.shape[1]
    if not together:
        return np.einsum("kd,ld,dt->klt", x * w, x, mu).ravel()
    out = np.empty((k, k, t, t))
    for i in range(k):
        for j in range(i, k):
            q = w * x[i] * x[j]
            out[i, j] = out[j, i] = np.diag(q @ mu) - (mu * q[:, None]).T @ mu
    return out.ravel()


def _newton_move(g: np.ndarray, h: np.ndarray, together: bool, free: int) -> np.ndarray:
    """The step h^-1 g for gradients g (k, t), on the first `free` rows; a little is added to what h leaves undetermined."""
    k, t = g.shape
    move = np.zeros_like(g)
    if together:
        full = h.reshape(k, k, t, t)[:free, :free].transpose(0, 2, 1, 3).reshape(free * t, free * t)
        full[np.diag_indices(free * t)] += 1e-8 * max(float(np.trace(full)) / (free * t), 1e-6)
        move[:free] = np.linalg.solve(full, g[:free].ravel()).reshape(free, t)
        return move
    blocks = h.reshape(k, k, t)[:free, :free].transpose(2, 0, 1).copy()
    blocks += 1e-9 * np.maximum(blocks[:, 0, 0], 1.0)[:, None, None] * np.eye(free)
    move[:free] = np.linalg.solve(blocks, g[:free].T[..., None])[..., 0].T
    return move


def fit_counts(packed: Packed, start: Counts | None = None, tau2: float = np.inf, steps: int = 50, curved: bool = True, tolerance: float = 1e-5) -> Counts:
    """lambda, rho and kappa per topic at fixed positions: Newton steps, halved until the loss does not rise; parameters are
    centred, as only their differences are identified. tau2 is the prior variance of kappa at these positions."""
    t = len(packed.items)
    c = start or Counts(np.zeros(t), np.zeros(t), np.zeros(t))
    p = np.stack([c.lam, c.rho, c.kap])
    kappa = c.kappa
    free = 3 if curved else 2
    together = 3 * t <= TOGETHER

    def step_sums(q: np.ndarray) -> np.ndarray:
        def f(b: Batch) -> np.ndarray:
            n = b.by_doc(b.y)
            w = b.weight / _dispersion(n, kappa)
            r = rates(b.theta, *q)
            mu, lse = softmax(r)
            x = np.stack([np.ones(b.documents), b.theta, b.theta**2 - 1])
            seen = np.stack([b.by_item(w[b.doc] * b.y * x[k][b.doc], t) for k in range(3)])
            grad = (x * (w * n)) @ mu - seen
            loss = (w * n * lse).sum() - (w[b.doc] * b.y * r[b.doc, b.item]).sum()
            return np.concatenate([grad.ravel(), _information(x, w * n, mu, together), [loss]])

        return packed.sums(f)

    def penalty(q: np.ndarray) -> float:
        return 0.0 if np.isinf(tau2) else float((q[2] ** 2).sum() / (2 * tau2))

    m = step_sums(p)
    losses = [m[-1] + penalty(p)]
    for _ in range(steps):
        g, h = m[: 3 * t].reshape(3, t).copy(), m[3 * t : -1].copy()
        if not np.isinf(tau2):
            g[2] += p[2] / tau2
            if together:
                h.reshape(3, 3, t, t)[2, 2][np.diag_indices(t)] += 1 / tau2
            else:
                h.reshape(3, 3, t)[2, 2] += 1 / tau2
        move = _newton_move(g, h, together, free)
        size = 1.0
        for _ in range(20):
            q = _centred(p - size * move)
            m2 = step_sums(q)
            loss = m2[-1] + penalty(q)
            if loss <= losses[-1] + 1e-12 * abs(losses[-1]):
                break
            size /= 2
        else:
            break
        p, m = q, m2
        losses.append(loss)
        if losses[-2] - losses[-1] <= tolerance * max(1.0, abs(losses[-1])):
            break
    return Counts(p[0], p[1], p[2], kappa, c.tau2, losses)


def dirichlet_scale(packed: Packed, c: Counts) -> float:
    """Moment estimate of the Dirichlet-multinomial scale; infinite where counts vary no more than a multinomial, 0 where
    they vary as much as they can."""
    t = len(c.lam)

    def f(b: Batch) -> np.ndarray:
        n = b.by_doc(b.y)
        mu, _ = softmax(rates(b.theta, c.lam, c.rho, c.kap))
        chi = b.by_doc(b.y**2 / (n[b.doc] * mu[b.doc, b.item])) - n
        return np.array([(b.weight * chi).sum(), (b.weight * n).sum(), b.weight.sum()])

    chi, n, w = packed.sums(f)
    r, m, base = chi / w, n / w, t - 1
    if r <= base:
        return np.inf
    return 0.0 if r >= base * m else float((base * m - r) / (r - base))


def square_deviation(packed: Packed) -> float:
    """Deviation of squared positions around their line on positions: by it a curvature is free of the scale of positions."""
    n, *sums = packed.sums(lambda b: np.array([float(b.documents), *((b.theta**k).sum() for k in range(1, 5))]))
    a, q, c, f = (x / max(n, 1.0) for x in sums)
    spread, both, own = q - a * a, c - a * q, f - q * q
    left = own - both**2 / spread if spread > 0 else own
    return max(float(np.sqrt(max(left, 0.0))), 64 * EPS)


def raw_variance(packed: Packed, c: Counts) -> float:
    """The prior variance of curvatures at the scale that positions have now."""
    return c.tau2 if np.isinf(c.tau2) else c.tau2 / square_deviation(packed) ** 2


def curvature_variance(packed: Packed, c: Counts, rounds: int = 25) -> Counts:
    """Empirical Bayes for the variance of curvatures: it becomes their mean square plus their posterior variance, until
    it changes by less than a thousandth. What is kept is the variance of standardized curvatures, which does not move with
    the scale of positions."""
    t = len(c.lam)
    tau2 = max(float((c.kap**2).mean()), 1e-12)
    for i in range(rounds):
        c = fit_counts(packed, c, tau2, steps=3)  # some way down is enough before the variance is looked at again
        lam, rho, kap, kappa = c.lam, c.rho, c.kap, c.kappa

        def f(b: Batch) -> np.ndarray:
            n = b.by_doc(b.y)
            mu, _ = softmax(rates(b.theta, lam, rho, kap))
            x = np.stack([np.ones(b.documents), b.theta, b.theta**2 - 1])
            return np.einsum("kd,ld,dt->tkl", x * (b.weight / _dispersion(n, kappa) * n), x, mu).ravel()

        h = packed.sums(f).reshape(t, 3, 3)
        h[:, 2, 2] += 1 / tau2
        h += 1e-10 * np.maximum(np.trace(h, axis1=1, axis2=2) / 3, 1.0)[:, None, None] * np.eye(3)
        new = max(float((c.kap**2 + np.maximum(np.linalg.inv(h)[:, 2, 2], 0.0)).mean()), 1e-14)
        done = abs(new - tau2) <= 1e-3 * tau2 and i > 0
        tau2 = new
        if done:
            break
    c.tau2 = tau2 * square_deviation(packed) ** 2
    return c


#: Nodes that a lattice has at most, gaps of it in one over the spread of loadings, nodes whose polynomial stands for a position,
#: and how far positions are looked for at first; where one goes further, so does the lattice.
NODES, FINE, AROUND, NEAR = 200_000, 10, 8, 5.0


@dataclass
class Lattice:
    """Evenly spaced positions, so close that what depends on a position alone follows from those around it (error about 1e-10).

    The normalising sum over items is a function of the position, the same for all documents: it is made at the nodes, not
    for every document. So are sums over documents of a function of their position: documents leave their weights at nodes."""

    reach: float
    start: float
    gap: float
    nodes: int

    @classmethod
    def of(cls, reach: float, beta: np.ndarray) -> Lattice | None:
        """For positions up to `reach` from 0; None where loadings are so far apart, or not finite, that it would be too long."""
        spread = float(np.ptp(beta))
        if not 2 * reach * FINE * spread <= NODES:
            return None
        gap = 1 / max(FINE * spread, 4)
        return cls(reach, -reach - gap * AROUND / 2, gap, math.ceil(2 * reach / gap) + 2 * AROUND)

    def shares(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes around each position, what share of it each has), both of AROUND rows."""
        x = (theta - self.start) / self.gap
        first = np.clip(np.floor(x).astype(np.int64) - (AROUND // 2 - 1), 0, self.nodes - AROUND)
        left = x - first - np.arange(AROUND)[:, None]
        before, after = np.ones_like(left), np.ones_like(left)
        for k in range(1, AROUND):
            before[k] = before[k - 1] * left[k - 1]
            after[-1 - k] = after[-k] * left[-k]
        base = np.array([math.prod(k - m for m in range(AROUND) if m != k) for k in range(AROUND)], dtype=float)
        return first + np.arange(AROUND)[:, None], before * after / base[:, None]

    def slices(self, psi: np.ndarray, beta: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(nodes, probabilities of items, log of the normalising sum) of the nodes `own`, some at a time."""
        step = max(1, DENSE // len(psi))
        for i in range(0, len(own), step):
            some = own[i : i + step]
            yield some, *softmax(psi + beta * (self.start + self.gap * some)[:, None])

    def normal(self, psi: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Log of the normalising sum, and mean and variance of loadings, at all nodes."""
        out = np.empty((3, self.nodes))
        for some, mu, lse in self.slices(psi, beta, np.arange(self.nodes)):
            mean = mu @ beta
            out[:, some] = lse, mean, np.maximum(mu @ beta**2 - mean**2, 0)
        return out


@dataclass
class PoissonFit:
    packed: Packed
    psi: np.ndarray
    beta: np.ndarray
    losses: list[float]


def fit_poisson(packed: Packed, sweeps: int = 50, prior_theta: float = 1.0, prior_beta: float = 0.1, cap: float | None = None, tolerance: float = 1e-6) -> PoissonFit:
    """Word or topic counts with log rate a_d + psi_j + beta_j theta_d; a_d is profiled out, so that a document's counts are a
    multinomial. Positions and loadings have normal priors; positions are standardized each sweep, and the largest loading is
    positive.

    One pass does a sweep: every document finds its position by itself, and what items need is added up, by way of a lattice
    of positions, so that a pass costs as much as there are cells, not documents times items. Standardized
    positions are a line of raw ones, so gradients and information on their scale follow from the sums. After two sweeps
    the items' movement is extrapolated; if that proves no better, the fit goes on from where it was. It ends when the loss
    of a sweep changes by no more than `tolerance` of it.
    """
    t = len(packed.items)
    total = packed.sums(lambda b: b.by_item(np.minimum(b.y, cap) if cap else b.y, t), dense=False)
    start = float(packed.table.agg(F.max(F.abs("theta")).alias("most")).first().most or 0)
    reach, farthest = start + NEAR, start + 25  # as far as 25 steps go
    psi = np.log(np.maximum(total, 0.5))
    psi -= psi.mean()
    beta = _first_axis(packed, psi, np.random.default_rng(11).normal(0, 0.1, t), cap)
    together = 2 * t <= TOGETHER
    parameters = np.stack([psi, beta])

    def place(b: Batch, now: np.ndarray, lattice: Lattice | None, normal: np.ndarray | None) -> tuple[np.ndarray, int]:
        """Positions, and of how many documents they were beyond the lattice on their way."""
        y = np.minimum(b.y, cap) if cap else b.y
        n, yb = b.by_doc(y), b.by_doc(y * now[1][b.item])
        theta, beyond = b.theta.copy(), np.zeros(b.documents, dtype=bool)
        for _ in range(25):
            if lattice is not None:
                at, share = lattice.shares(theta)
                e, v = (share * normal[1][at]).sum(axis=0), (share * normal[2][at]).sum(axis=0)
            else:
                mu, _ = softmax(now[0] + now[1] * theta[:, None])
                e = mu @ now[1]
                v = mu @ now[1] ** 2 - e**2
            v = np.maximum(v, 1e-9)
            step = np.clip((yb - n * e - theta / prior_theta) / (n * v + 1 / prior_theta), -1, 1)
            theta += step
            if lattice is not None:
                beyond |= np.abs(theta) > lattice.reach
                theta = np.clip(theta, -lattice.reach, lattice.reach)
            if np.abs(step).max(initial=0.0) < 1e-9:
                break
        return theta, int(beyond.sum())

    def spread_sums(now: np.ndarray, lattice: Lattice) -> np.ndarray | None:
        """What a sweep adds up, by way of the lattice: documents give their positions' sums and leave counts at nodes. None if
        it doesn't reach far enough."""
        normal = lattice.normal(*now)

        def f(b: Batch) -> np.ndarray:
            y = np.minimum(b.y, cap) if cap else b.y
            n, (theta, beyond) = b.by_doc(y), place(b, now, lattice, normal)
            at, share = lattice.shares(theta)
            loss = n @ (share * normal[0][at]).sum(axis=0) - theta @ b.by_doc(y * now[1][b.item])
            left = [np.bincount(at.ravel(), weights=(share * (n * theta**k)).ravel(), minlength=lattice.nodes) for k in range(3)]
            return np.concatenate([[b.documents, theta.sum(), (theta**2).sum(), loss], b.by_item(y * theta[b.doc], t), *left, [beyond]])

        m = packed.sums(f, dense=False)
        if m[-1]:
            return None
        left = m[4 + t : -1].reshape(3, lattice.nodes)
        expected, pairs = np.zeros((3, t)), np.zeros((3, t, t) if together else 0)
        for some, mu, _ in lattice.slices(*now, np.flatnonzero(left.any(axis=0))):
            expected += left[:, some] @ mu
            for k in range(3 if together else 0):
                pairs[k] += (mu * left[k, some, None]).T @ mu
        g = np.stack([total, m[4 : 4 + t]]) - expected[:2]
        h = np.stack([np.stack([(np.diag(expected[i + j]) - pairs[i + j]) if together else expected[i + j] for j in range(2)]) for i in range(2)])
        return np.concatenate([m[:3], [m[3] - total @ now[0]], g.ravel(), h.ravel()])

    def sweep(now: np.ndarray) -> tuple[np.ndarray, float, float, float]:
        """(the items' parameters after a sweep, loss before it, mean and deviation of raw positions)."""

        def f(b: Batch) -> np.ndarray:
            y = np.minimum(b.y, cap) if cap else b.y
            n, (theta, _) = b.by_doc(y), place(b, now, None, None)
            r = now[0] + now[1] * theta[:, None]
            mu, lse = softmax(r)
            x = np.stack([np.ones(b.documents), theta])
            g = np.stack([b.by_item(y * x[k][b.doc], t) for k in range(2)]) - (x * n) @ mu
            loss = (n * lse).sum() - (y * r[b.doc, b.item]).sum()
            return np.concatenate([[b.documents, theta.sum(), (theta**2).sum(), loss], g.ravel(), _information(x, n, mu, together)])

        nonlocal reach
        m = None
        while m is None:
            lattice = Lattice.of(reach, now[1])
            m = packed.sums(f) if lattice is None else spread_sums(now, lattice)
            if m is None:
                reach = min(2 * reach, farthest)
        mean, sd = _standard(*m[:3])
        turn = np.array([[1.0, 0.0], [-mean / sd, 1 / sd]])  # regressors on the scale of standardized positions
        g = turn @ m[4 : 4 + 2 * t].reshape(2, t)
        shape = (2, 2, t, t) if together else (2, 2, t)
        h = np.einsum("ka,lb,ab...->kl...", turn, turn, m[4 + 2 * t :].reshape(shape)).copy()
        p = np.stack([now[0] + now[1] * mean, now[1] * sd])
        loss = float(m[3] + m[0] / (2 * prior_theta) + (p[1] ** 2).sum() / (2 * prior_beta))
        g[1] -= p[1] / prior_beta
        if together:
            h[1, 1][np.diag_indices(t)] += 1 / prior_beta
        else:
            h[1, 1] += 1 / prior_beta
        move = _newton_move(g, h.ravel(), together, 2)
        p = p + move * min(1.0, 2 / max(float(np.abs(move).max()), 1e-12))
        p[0] -= p[0].mean()
        return p, loss, mean, sd

    losses: list[float] = []
    trail, fallback = [parameters], None
    for _ in range(sweeps):
        after, loss, _, _ = sweep(parameters)
        if fallback is not None and not (np.isfinite(loss) and loss <= losses[-1] + 1e-9 * abs(losses[-1])):
            parameters, fallback, trail = fallback, None, [fallback]  # the extrapolation was no good
            continue
        fallback = None
        losses.append(loss)
        parameters = after
        trail.append(after)
        if len(losses) > 1 and abs(losses[-2] - losses[-1]) <= tolerance * abs(losses[-1]):
            break
        if len(trail) == 3:
            first, second = trail[1] - trail[0], trail[2] - 2 * trail[1] + trail[0]
            bend = float(np.linalg.norm(second))
            if bend > 1e-12:
                a = -max(1.0, float(np.linalg.norm(first)) / bend)
                fallback, parameters = after, trail[0] - 2 * a * first + a * a * second
            trail = [parameters]
    _, loss, mean, sd = sweep(parameters)
    losses.append(loss)
    psi, beta = parameters[0] + parameters[1] * mean, parameters[1] * sd
    sign = -1.0 if beta[np.abs(beta).argmax()] < 0 else 1.0
    last, lattice = parameters, Lattice.of(reach, parameters[1])
    normal = lattice and lattice.normal(*last)
    placed = packed.moved(lambda b: sign * (place(b, last, lattice, normal)[0] - mean) / sd, dense=lattice is None)
    return PoissonFit(placed, psi - psi.mean(), sign * beta, losses)


def poisson_errors(f: PoissonFit, prior_theta: float = 1.0, prior_beta: float = 0.1, cap: float | None = None) -> tuple[Packed, np.ndarray]:
    """Standard errors of positions (as the positions of a packed table) and of loadings: the inverse information of each
    document and of each item, intercepts profiled out."""
    psi, beta = f.psi, f.beta

    def shares(b: Batch) -> tuple[np.ndarray, np.ndarray]:
        y = np.minimum(b.y, cap) if cap else b.y
        return b.by_doc(y), softmax(psi + beta * b.theta[:, None])[0]

    def of_documents(b: Batch) -> np.ndarray:
        n, mu = shares(b)
        mean = mu @ beta
        return 1 / np.sqrt(n * np.maximum(mu @ beta**2 - mean**2, 0.0) + 1 / prior_theta + 1e-8)

    def of_items(b: Batch) -> np.ndarray:
        n, mu = shares(b)
        x = np.stack([np.ones(b.documents), b.theta, b.theta**2])
        return ((x * n) @ mu).ravel()

    w, wt, wtt = f.packed.sums(of_items).reshape(3, len(psi))
    information = wtt + 1 / prior_beta + 1e-8 - wt**2 / (w + 1e-8)
    return f.packed.moved(of_documents), 1 / np.sqrt(np.maximum(information, 1e-300))


def _first_axis(packed: Packed, psi: np.ndarray, beta: np.ndarray, cap: float | None, rounds: int = 4) -> np.ndarray:
    """Loadings to start from: power steps on the residuals of the independence model, over root expectation."""
    t = len(psi)
    share = np.exp(psi) / np.exp(psi).sum()
    root = np.sqrt(share)
    v = beta / np.linalg.norm(beta)
    for _ in range(rounds):
        u = v

        def f(b: Batch) -> np.ndarray:
            y = np.minimum(b.y, cap) if cap else b.y
            n = b.by_doc(y)
            score = b.by_doc(y * (u / root)[b.item]) / np.sqrt(n) - np.sqrt(n) * (u @ root)
            return b.by_item(y / np.sqrt(n)[b.doc] * score[b.doc], t) / root - root * (np.sqrt(n) * score).sum()

        v = packed.sums(f, dense=False)
        v -= root * (root @ v)
        v /= max(np.linalg.norm(v), 1e-300)
    x = v / np.maximum(root, 1e-9)
    return np.clip(0.3 * x / max(np.abs(x).std(), 1e-9), -1, 1)


def correspondence(packed: Packed, rounds: int = 40, tolerance: float = 1e-9, width: int = 6) -> tuple[Packed, np.ndarray, float]:
    """First axis of correspondence analysis: positions of documents, of items, and the singular value.

    Each pass multiplies `width` directions at once with the residual table and its transpose; between passes they are made
    orthonormal, and the best direction within them is read from a matrix of that size (subspace iteration), so that few
    passes suffice even where axes are nearly as strong as each other. Centring is arithmetic on margins; the residual table
    is never made. It ends when the axis itself stands still."""
    t = len(packed.items)
    total = packed.sums(lambda b: b.by_item(b.y, t))
    n = total.sum()
    c = total / n
    root = np.sqrt(c)
    k = min(width, max(1, t - 1))
    v = np.random.default_rng(5).normal(size=(t, k))
    axis, value = np.zeros(t), 0.0
    for _ in range(rounds):
        v -= root[:, None] * (root @ v)
        v, _ = np.linalg.qr(v)
        u = v / root[:, None]

        def f(b: Batch, u=u) -> np.ndarray:
            r = b.by_doc(b.y)
            out = []
            for x in u.T:
                score = b.by_doc(b.y * x[b.item]) / r - (c * x).sum()
                out += [b.by_item(b.y * score[b.doc], t), [(r * score).sum()]]
            return np.concatenate(out)

        m = packed.sums(f).reshape(k, t + 1)
        x = (m[:, :t] / n / root - root * m[:, t:] / n).T
        values, turn = np.linalg.eigh(v.T @ x)
        new, value = v @ turn[:, -1], float(values[-1])
        moved = 1 - abs(float(axis @ new))
        axis, v = new, x @ turn
        if moved <= tolerance:
            break
    u = axis / root
    if u[np.abs(u).argmax()] < 0:
        u = -u
    shift, sigma = float((c * u).sum()), float(np.sqrt(max(value, 0.0)))
    placed = packed.moved(lambda b: (b.by_doc(b.y * u[b.item]) / b.by_doc(b.y) - shift) / max(sigma, 1e-300))
    return placed, u, sigma
