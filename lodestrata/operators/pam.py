"""k-medoids on a bounded set of weighted rows, in numpy: greedy build, best-swap and eager-swap searches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.distance import Metric

MOST_BYTES = 2 << 30
FAR = np.finfo(float).max


def distance_matrix(points: np.ndarray, metric: Metric) -> np.ndarray:
    n = len(points)
    if n * n > 2**31 - 1 or 8 * n * n > MOST_BYTES:
        raise ValueError(f"a distance matrix of {n} rows is too large: {8 * n * n} bytes")
    d = metric.block(points, points)
    upper = np.triu(d)
    return upper + np.triu(d, 1).T


def build(d: np.ndarray, w: np.ndarray, k: int) -> list[int]:
    """Greedy medoids: the least total distance first, then the greatest gain, the lowest index on ties."""
    medoids = [int((d * w[None, :]).sum(axis=1).argmin())]
    near = d[medoids[0]].copy()
    while len(medoids) < k:
        gain = (w[None, :] * np.maximum(0.0, near[None, :] - d)).sum(axis=1)
        gain[medoids] = -np.inf
        medoids.append(int(gain.argmax()))
        near = np.minimum(near, d[medoids[-1]])
    return medoids


@dataclass
class Cache:
    """Per row: slot and distance of the nearest medoid, distance of the second."""

    slot: np.ndarray
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def of(cls, d: np.ndarray, medoids: list[int]) -> Cache:
        own = d[medoids]
        slot = own.argmin(axis=0)
        first = own[slot, np.arange(d.shape[1])]
        if len(medoids) == 1:
            return cls(slot, first, np.full(d.shape[1], FAR))
        rest = own.copy()
        rest[slot, np.arange(d.shape[1])] = np.inf
        return cls(slot, first, rest.min(axis=0))


def deltas(d: np.ndarray, w: np.ndarray, cache: Cache, k: int, candidate: int) -> np.ndarray:
    """Change of the cost when ``candidate`` takes the place of each medoid."""
    own = d[candidate]
    shared = np.where(own < cache.first, w * (own - cache.first), 0.0)
    loss = w * (np.minimum(cache.second, own) - cache.first) - shared
    return shared.sum() + np.bincount(cache.slot, loss, k)


@dataclass
class Solution:
    medoids: list[int]
    cost: float
    iterations: int


def _checked(points: np.ndarray, weights: np.ndarray, k: int) -> None:
    if len(points) < k:
        raise ValueError(f"dataset too small: {len(points)} rows for k = {k}")
    if len(points) != len(weights):
        raise ValueError("points and weights differ in length")


@dataclass
class FastPAM:
    """The best of all swaps each round: lower change, then lower slot, then lower candidate."""

    k: int
    max_iter: int = 100
    metric: Metric | None = None

    def fit_local(self, points: np.ndarray, weights: np.ndarray) -> Solution:
        _checked(points, weights, self.k)
        d = distance_matrix(points, self.metric)
        medoids = build(d, weights, self.k)
        rounds = 0
        while rounds < self.max_iter:
            rounds += 1
            cache = Cache.of(d, medoids)
            inside = set(medoids)
            best = min((((change := deltas(d, weights, cache, self.k, h)).min(), int(change.argmin()), h) for h in range(len(points)) if h not in inside), default=(0.0, 0, 0))
            if not best[0] < 0:
                break
            medoids[best[1]] = best[2]
        return Solution(medoids, float((weights * Cache.of(d, medoids).first).sum()), rounds)


@dataclass
class FasterPAM:
    """Swaps as soon as one helps; ends after a full pass without a swap. Rounds are passes."""

    k: int
    max_iter: int = 100
    metric: Metric | None = None
    seed: int = 42

    def fit_local(self, points: np.ndarray, weights: np.ndarray) -> Solution:
        _checked(points, weights, self.k)
        d = distance_matrix(points, self.metric)
        medoids = build(d, weights, self.k)
        cache = Cache.of(d, medoids)
        order = np.random.default_rng(self.seed).permutation(len(points))
        passes = 0
        while passes < self.max_iter:
            passes += 1
            swapped = False
            for h in order.tolist():
                if h in medoids:
                    continue
                change = deltas(d, weights, cache, self.k, h)
                slot = int(change.argmin())
                if change[slot] < 0:
                    medoids[slot] = h
                    cache = Cache.of(d, medoids)
                    swapped = True
            if not swapped:
                break
        return Solution(medoids, float((weights * cache.first).sum()), passes)


SOLVERS = ("fasterpam", "fastpam")


def solver(name: str, k: int, max_iter: int, metric: Metric, seed: int) -> FastPAM | FasterPAM:
    kind = name.lower()
    if kind == "fastpam":
        return FastPAM(k, max_iter, metric)
    if kind == "fasterpam":
        return FasterPAM(k, max_iter, metric, seed)
    raise ValueError(f"Unknown inner k-medoids solver: '{name}'. Known: {', '.join(SOLVERS)}")
