"""Non-negative factors of a document-by-term table."""

from __future__ import annotations

import numpy as np

from .packed import Batch, Packed


def fit_nmf(packed: Packed, k: int, rounds: int = 30, inner: int = 10, tolerance: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, list[float]]:
    """(topics by terms, losses) of a Frobenius factorisation. Terms' factors live on the driver; a pass solves every document's
    weights by multiplicative steps and adds up the two Gram matrices that the terms' update needs, of sizes k x k and k x terms."""
    t = len(packed.items)
    h = np.random.default_rng(seed).uniform(0.1, 1.0, (k, t))
    losses: list[float] = []
    for _ in range(rounds):
        now = h

        def f(b: Batch) -> np.ndarray:
            x = np.zeros((b.documents, t))
            np.add.at(x, (b.doc, b.item), b.y)
            xh, hh = x @ now.T, now @ now.T
            w = np.full((b.documents, k), max(x.mean(), 1e-9))
            for _ in range(inner):
                w *= xh / np.maximum(w @ hh, 1e-12)
            return np.concatenate([(w.T @ w).ravel(), (w.T @ x).ravel(), [((x - w @ now) ** 2).sum()]])

        m = packed.sums(f)
        ww, wx = m[: k * k].reshape(k, k), m[k * k : k * k + k * t].reshape(k, t)
        losses.append(float(m[-1]))
        if len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * losses[-2]:
            break
        for _ in range(inner):
            h = h * wx / np.maximum(ww @ h, 1e-12)
    return h, losses
