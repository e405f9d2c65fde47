"""A belief by bins as a mixture of Gaussians, and back."""

from __future__ import annotations

import numpy as np


def fit(points: np.ndarray, weight: np.ndarray, parts: int, rounds: int, centres: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, centres, sigmas) of ``parts`` round Gaussians, by weighted k-means.

    Without ``centres`` to begin with, the first is the heaviest point and each next one the point farthest from those
    chosen. A part without points keeps its centre. sigma is the root of half the mean squared distance.
    """
    x, z = points[:, 0].astype(float), points[:, 1].astype(float)
    if centres is None:
        chosen = [int(weight.argmax())]
        far = np.full(len(x), np.inf)
        for _ in range(parts - 1):
            a, b = x - x[chosen[-1]], z - z[chosen[-1]]
            np.minimum(far, a * a + b * b, out=far)
            chosen.append(int(far.argmax()))
        centres = points[chosen]
    centres, before = centres.astype(float).copy(), None
    for last in [False] * rounds + [True]:
        a, b = x[:, None] - centres[:, 0], z[:, None] - centres[:, 1]
        d2 = a * a + b * b
        part = d2.argmin(1)
        mass = np.bincount(part, weight, parts)
        # Parts that keep their points keep them in all further rounds.
        if last or (before is not None and (part == before).all()):
            spread = np.bincount(part, weight * d2[np.arange(len(points)), part], parts)
            return mass / mass.sum(), centres, np.sqrt(spread / np.where(mass > 0, mass, 1.0) / 2)
        before = part
        for axis in (0, 1):
            centres[:, axis] = np.where(mass > 0, np.bincount(part, weight * (z if axis else x), parts) / np.where(mass > 0, mass, 1.0), centres[:, axis])


def raster(weights: np.ndarray, centres: np.ndarray, sigmas: np.ndarray, middles: np.ndarray, least: float) -> np.ndarray:
    """Density of the mixture at ``middles``; sigmas count as ``least`` at least, and a part reaches three of them."""
    s = np.maximum(sigmas, least)
    a, b = middles[:, :1] - centres[:, 0], middles[:, 1:] - centres[:, 1]
    d2 = a * a + b * b
    near = np.nonzero(d2 <= 9 * s * s)
    height = np.zeros(d2.shape)
    height[near] = np.exp(-d2[near] / (2 * s * s)[near[1]]) * (weights / (2 * np.pi * s * s))[near[1]]
    return height.sum(1)


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Kullback-Leibler divergence of p from q in nats; both are brought to the sum 1, q with a floor."""
    p, q = p / p.sum(), (q + 1e-12) / (q + 1e-12).sum()
    on = np.flatnonzero(p > 0)
    return float((p[on] * np.log(p[on] / q[on])).sum())
