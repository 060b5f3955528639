"""Stance scaling: alternating weighted least squares of mean stances on document positions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from .packed import Batch, Packed

EPS = np.finfo(float).eps


@dataclass
class StanceFit:
    packed: Packed
    alpha: np.ndarray
    beta: np.ndarray
    sigma2: float
    losses: list[float] = field(default_factory=list)


def _item_lines(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares lines of stance on position, one an item, from sums of w, w t, w t t, w s, w t s. In centred moments the
    slope is covariance over variance; items without weight, and those whose positions differ no more than rounding does,
    have slope 0."""
    raw = np.asarray(m, dtype=float)
    total = np.where(raw[0] > 0, raw[0], 1.0)
    t, tt, s, ts = raw[1:] / total
    variance, covariance = tt - t**2, ts - t * s
    noise = 64 * EPS * np.maximum(1.0, np.maximum(tt, np.abs(t)))
    told = (raw[0] > 0) & (variance > noise)
    slope = np.zeros_like(t)
    slope[told] = covariance[told] / variance[told]
    return s - slope * t, slope


def _standard(n: float, total: float, squares: float) -> tuple[float, float]:
    mean = total / max(n, 1e-300)
    sd = np.sqrt(max(squares / max(n, 1e-300) - mean * mean, 0.0))
    if not sd > 0:
        raise ValueError("positions have no spread")
    return float(mean), float(sd)


def _moments(b: Batch, theta: np.ndarray, items: int, more: np.ndarray) -> np.ndarray:
    """Everything the next item update needs, in one vector."""
    w, t, s = b.weight[b.doc] * b.y, theta[b.doc], b.s / b.y
    return np.concatenate([*(b.by_item(x, items) for x in (w, w * t, w * t * t, w * s, w * t * s, w * s * s)), [b.weight.sum(), (b.weight * theta).sum(), (b.weight * theta**2).sum()], more])


def _start(b: Batch) -> np.ndarray:
    return b.by_doc(np.clip(b.s, -b.y, b.y)) / b.by_doc(b.y)


def _solve(b: Batch, alpha: np.ndarray, beta: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """The position of each document at which the lines of its cells meet its mean stances best: the projection of what the
    intercepts leave over onto the slopes. With a ridge it is drawn to 0; without one, documents whose cells have no slope
    stay there."""
    line = beta[b.item]
    left = b.s - alpha[b.item] * b.y  # stance sums less what intercepts explain
    along, length = b.by_doc(line * left), b.by_doc(line * line * b.y) + ridge
    told = length > 64 * EPS * max(1.0, float(np.max(length, initial=0.0)))
    out = np.zeros(b.documents)
    out[told] = along[told] / length[told]
    return out


def _scaled(m: np.ndarray, items: int) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Item moments of standardized positions, from those of raw ones."""
    table, (n, t, tt) = m[: 6 * items].reshape(6, items), m[6 * items : 6 * items + 3]
    mean, sd = _standard(n, t, tt)
    w, wt, wtt, ws, wts, wss = table
    return np.stack([w, (wt - mean * w) / sd, (wtt - 2 * mean * wt + mean**2 * w) / sd**2, ws, (wts - mean * ws) / sd, wss]), mean, sd, m[6 * items + 3 :]


def _loss(k: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> float:
    w, wt, wtt, ws, wts, wss = k
    return float((wss - 2 * alpha * ws - 2 * beta * wts + alpha**2 * w + 2 * alpha * beta * wt + beta**2 * wtt).sum() / 2)


def fit_stance(packed: Packed, sweeps: int = 100, tolerance: float = 1e-4, orientation: float = 1.0) -> StanceFit:
    """alpha and beta per topic, a position per document, and the residual variance.

    Positions start as the standardized mean stance. A sweep fits every topic's line and then every document's position,
    standardized with the lines moved along; one pass does both, as item sums of standardized positions follow from those
    of raw ones. It ends when a sweep's gain is below `tolerance` of the largest three times in a row.
    """
    t = len(packed.items)
    m = packed.sums(lambda b: _moments(b, orientation * _start(b), t, np.zeros(1)))
    k, mean, sd, _ = _scaled(m, t)
    alpha, beta = _item_lines(k[:5])
    losses, largest, calm = [_loss(k, alpha, beta)], 0.0, 0
    for _ in range(sweeps):
        a, b_ = alpha, beta
        m = packed.sums(lambda b: _moments(b, _solve(b, a, b_), t, np.zeros(1)))
        k, mean, sd, _ = _scaled(m, t)
        # Positions are now standardized, so the lines are fitted anew on that scale.
        alpha, beta = _item_lines(k[:5])
        last = (a, b_, mean, sd)
        losses.append(_loss(k, alpha, beta))
        gain = losses[-2] - losses[-1]
        largest = max(largest, gain)
        calm = calm + 1 if gain / max(1.0, largest) <= tolerance else 0
        if calm >= 3:
            break
    a, b_, mean, sd = last
    placed = packed.moved(lambda b: (_solve(b, a, b_) - mean) / sd)
    weight = float(k[0].sum())
    return StanceFit(placed, alpha, beta, 2 * losses[-1] / max(weight, EPS), losses)


def fit_stance_ridge(packed: Packed, sweeps: int = 400, tolerance: float = 1e-8, ridge: float = 1.0) -> StanceFit:
    """The plain factor model of mean stances: a line per topic weighted by counts, positions with a ridge, standardized over
    documents (unweighted) each sweep. It ends when no line moves by `tolerance` any more, and with the lines the positions
    stand still. Documents' own weights are not used."""
    t = len(packed.items)
    one = lambda b, theta, more: _moments(replace(b, weight=np.ones(b.documents)), theta, t, np.array([more]))
    k, mean, sd, _ = _scaled(packed.sums(lambda b: one(b, _start(b), 0.0)), t)
    alpha, beta = _item_lines(k[:5])
    losses, now = [_loss(k, alpha, beta)], (alpha, beta)
    for _ in range(sweeps):
        now = (alpha, beta)
        k, mean, sd, _ = _scaled(packed.sums(lambda b, now=now: one(b, _solve(b, *now, ridge), 0.0)), t)
        alpha, beta = _item_lines(k[:5])
        losses.append(_loss(k, alpha, beta))
        if max(np.abs(alpha - now[0]).max(), np.abs(beta - now[1]).max()) < tolerance:
            break
    a, c = now
    placed = packed.moved(lambda b: (_solve(b, a, c, ridge) - mean) / sd)
    return StanceFit(placed, alpha, beta, 2 * losses[-1] / max(float(k[0].sum()), EPS), losses)
