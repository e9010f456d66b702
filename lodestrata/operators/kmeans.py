"""Lloyd's k-means, Euclidean or spherical, weighted; with breathing refinement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..functions.distance import nearest
from ..functions.geometry import EUCLIDEAN_GEOMETRY, Geometry
from ..functions.weights import with_weights
from .fold import dimension, fold
from .models import Clusterer, KMeansModel
from .sampling import weighted_top


def converged(before: np.ndarray, after: np.ndarray, eps: float, geometry: Geometry) -> bool:
    """Every centre moved less than eps."""
    moved = np.array([geometry.fit_metric.block(a[None, :], b[None, :])[0, 0] for a, b in zip(before, after, strict=True)])
    return bool((moved < eps).all())


def lloyd_sums(points: DataFrame, centres: np.ndarray, geometry: Geometry) -> np.ndarray:
    """Per centre the weighted sum of its points and their mass."""
    k, d = centres.shape
    metric = geometry.fit_metric

    def step(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        at = nearest(metric, x, centres)[0]
        out = np.zeros((k, d + 1))
        for j in range(d):
            out[:, j] = np.bincount(at, w * x[:, j], k)
        out[:, d] = np.bincount(at, w, k)
        return out.ravel()

    return fold(points, k * (d + 1), step).reshape(k, d + 1)


def moved(centres: np.ndarray, sums: np.ndarray, geometry: Geometry) -> np.ndarray:
    """New centres; one without mass stays where it was."""
    mass = sums[:, -1]
    means = sums[:, :-1] / np.where(mass > 0, mass, 1.0)[:, None]
    return np.where((mass > 0)[:, None], geometry.project(means), centres)


def lloyd(points: DataFrame, centres: np.ndarray, max_iter: int, eps: float, geometry: Geometry) -> tuple[np.ndarray, int]:
    """Centres after convergence or ``max_iter`` rounds, and the rounds. ``points`` are prepared and weighted."""
    for i in range(max_iter):
        new = moved(centres, lloyd_sums(points, centres, geometry), geometry)
        done = converged(centres, new, eps, geometry)
        centres = new
        if done:
            return centres, i + 1
    return centres, max_iter


class Prepared:
    """Weighted points in the geometry's form; only what the geometry computed is cached, and released at the end."""

    def __init__(self, df: DataFrame, geometry: Geometry):
        self.points = geometry.prepare(with_weights(df))
        self.owned = geometry.transforms
        if self.owned:
            self.points.persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> DataFrame:
        return self.points

    def __exit__(self, *_) -> None:
        if self.owned:
            self.points.unpersist()


@dataclass
class KMeans(Clusterer):
    k: int
    max_iter: int = 100
    eps: float = 1e-4
    seed: int = 42
    geometry: Geometry = EUCLIDEAN_GEOMETRY

    def fit(self, df: DataFrame, init: np.ndarray | None = None) -> KMeansModel:
        with Prepared(df, self.geometry) as points:
            start = weighted_top(points, self.k, self.seed) if init is None else self.geometry.project(np.array(init, float))
            centres, rounds = lloyd(points, start, self.max_iter, self.eps, self.geometry)
        return KMeansModel(centres, self.geometry.model_metric, rounds)


def breathing_stats(points: DataFrame, centres: np.ndarray, geometry: Geometry) -> np.ndarray:
    """Per centre: mass, error, and utility (what its points would cost more at their second centre)."""
    k, metric = len(centres), geometry.fit_metric

    def step(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        d = metric.block_ordinal(x, centres)
        at = d.argmin(axis=1)
        first = d[np.arange(len(x)), at]
        second = np.partition(d, 1, axis=1)[:, 1] if k > 1 else first
        a, b = geometry.cost(first), geometry.cost(second)
        return np.stack([np.bincount(at, w, k), np.bincount(at, w * a, k), np.bincount(at, w * (b - a), k)], axis=1).ravel()

    return fold(points, 3 * k, step).reshape(k, 3)


def inserted(centres: np.ndarray, stats: np.ndarray, m: int, rng: np.random.Generator, geometry: Geometry) -> np.ndarray:
    """A neighbour beside each of the m centres with the greatest error."""
    worst = np.lexsort((np.arange(len(centres)), -stats[:, 1]))[: min(m, len(centres))]
    mass = stats[:, 0].sum()
    scale = geometry.cost_to_distance(stats[:, 1].sum() / mass) if mass > 0 else 0.0
    return geometry.project(centres[worst] + 0.01 * scale * (rng.random((len(worst), centres.shape[1])) - 0.5))


def removed(centres: np.ndarray, utility: np.ndarray, count: int, geometry: Geometry) -> np.ndarray:
    """Indices that stay when the ``count`` least useful go; each pick freezes its nearest neighbour while enough are left."""
    order = np.lexsort((np.arange(len(centres)), utility))
    gone: set[int] = set()
    frozen: set[int] = set()
    for i in order.tolist():
        if len(gone) == count:
            break
        if i in frozen:
            continue
        gone.add(i)
        if len(frozen) + count < len(centres):
            d = geometry.fit_metric.block_ordinal(centres[i : i + 1], centres)[0]
            d[[*gone]] = np.inf
            if np.isfinite(d).any():
                frozen.add(int(d.argmin()))
    for i in order.tolist():
        if len(gone) == count:
            break
        gone.add(i)
    return np.array([i for i in range(len(centres)) if i not in gone])


@dataclass
class BreathingKMeans(Clusterer):
    """k-means that inserts and removes centres by turns, and keeps a turn only if it lowers the cost."""

    k: int
    m0: int = 5
    max_iter: int = 100
    eps: float = 1e-4
    seed: int = 42
    geometry: Geometry = EUCLIDEAN_GEOMETRY
    max_cycles: int = 100

    def fit(self, df: DataFrame, init: np.ndarray | None = None) -> KMeansModel:
        g, rng = self.geometry, np.random.default_rng(self.seed)
        with Prepared(df, g) as points:
            start = weighted_top(points, self.k, self.seed) if init is None else g.project(np.array(init, float))
            best, rounds = lloyd(points, start, self.max_iter, self.eps, g)
            stats = breathing_stats(points, best, g)
            m, cycles = self.m0, 0
            while m > 0 and cycles < self.max_cycles:
                cycles += 1
                wide, a = lloyd(points, np.vstack([best, inserted(best, stats, m, rng, g)]), self.max_iter, self.eps, g)
                keep = removed(wide, breathing_stats(points, wide, g)[:, 2], len(wide) - self.k, g)
                narrow, b = lloyd(points, wide[keep], self.max_iter, self.eps, g)
                rounds += a + b
                now = breathing_stats(points, narrow, g)
                if now[:, 1].sum() < stats[:, 1].sum():
                    best, stats = narrow, now
                else:
                    m -= 1
        return KMeansModel(best, g.model_metric, rounds)


def mean_of(points: DataFrame) -> tuple[np.ndarray, float]:
    """Weighted mean and mass."""
    d = dimension(points)
    sums = fold(points, d + 1, lambda x, w: np.append(w @ x, w.sum()))
    return sums[:d] / sums[d] if sums[d] > 0 else sums[:d], float(sums[d])
