"""k-medoids on whole data: sampled solves scored in one scan (CLARA), then Voronoi refinement (PAMAE)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..columns import FEATURES
from ..functions.distance import Metric, nearest
from ..functions.weights import with_weights
from .fold import fold
from .models import Clusterer, KMedoidsModel
from .pam import solver
from .sampling import multi_sample, pool


def medoid_costs(points: DataFrame, sets: list[np.ndarray], metric: Metric) -> np.ndarray:
    """Weighted distance of all rows to the nearest medoid, for every set, in one scan."""
    if not sets:
        raise ValueError("at least one medoid set is needed")

    def step(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.array([(w * metric.distance(nearest(metric, x, s)[1])).sum() for s in sets])

    return fold(points, len(sets), step)


@dataclass
class CLARA(Clusterer):
    k: int
    num_samples: int = 5
    sample_size: int = 1000
    max_iter: int = 100
    metric: Metric | None = None
    inner: str = "fastpam"
    seed: int = 42

    def __post_init__(self):
        solver(self.inner, self.k, self.max_iter, self.metric, self.seed)

    def seed_medoids(self, points: DataFrame) -> tuple[KMedoidsModel, float, int]:
        """The cheapest sample's medoids on the whole data, their cost, and the number of rows."""
        rows = points.count()
        samples = multi_sample(points, self.num_samples, self.sample_size, rows, self.seed)
        k, size, own = self.k, self.sample_size, solver(self.inner, self.k, self.max_iter, self.metric, self.seed)
        seed = self.seed

        def solved(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            x, w = np.array(frame[FEATURES].tolist(), float), frame["weight"].to_numpy(float)
            if len(x) > size:
                keep = np.random.default_rng(seed + int(key[0])).permutation(len(x))[:size]
                x, w = x[keep], w[keep]
            if len(x) < k:
                return pd.DataFrame({"sample_id": [key[0]], "medoids": [None], "iterations": [len(x)]})
            found = own.fit_local(x, w)
            return pd.DataFrame({"sample_id": [key[0]], "medoids": [x[found.medoids].tolist()], "iterations": [found.iterations]})

        results = sorted(samples.groupBy("sample_id").applyInPandas(solved, "sample_id int, medoids array<array<double>>, iterations int").collect(), key=lambda r: r.sample_id)
        if not results or any(r.medoids is None for r in results):
            raise ValueError(f"dataset too small: a sample has fewer than k = {k} rows")
        sets = [np.array(r.medoids) for r in results]
        costs = medoid_costs(points, sets, self.metric)
        best = int(costs.argmin())
        return KMedoidsModel(sets[best], self.metric, results[best].iterations), float(costs[best]), rows

    def fit(self, df: DataFrame) -> KMedoidsModel:
        return self.seed_medoids(with_weights(df))[0]


def candidate_costs(points: DataFrame, medoids: np.ndarray, candidates: np.ndarray, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each candidate, its weighted distance to the rows of that slot)."""
    slot = nearest(metric, candidates, medoids)[0]

    def step(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        at = nearest(metric, x, medoids)[0]
        out = np.zeros(len(candidates))
        for s in np.unique(slot):
            rows = at == s
            if rows.any():
                own = np.flatnonzero(slot == s)
                out[own] = (w[rows][:, None] * metric.block(x[rows], candidates[own])).sum(axis=0)
        return out

    return slot, fold(points, len(candidates), step)


def refine(points: DataFrame, medoids: np.ndarray, candidates: np.ndarray, metric: Metric, rounds: int) -> tuple[np.ndarray, float, int]:
    """(medoids, cost, rounds run): each slot takes its cheapest candidate, the incumbent unless strictly beaten; a
    round counts only if medoids changed and its cost is below the best so far."""
    best, ran = np.inf, 0
    while ran < rounds:
        ran += 1
        every = np.vstack([candidates, medoids])
        slot, cost = candidate_costs(points, medoids, every, metric)
        new, total = medoids.copy(), 0.0
        for s in range(len(medoids)):
            own = np.flatnonzero(slot == s)
            incumbent = len(candidates) + s
            if not len(own):
                continue
            pick = own[cost[own].argmin()]
            if slot[incumbent] == s and cost[pick] >= cost[incumbent]:
                pick = incumbent
            new[s] = every[pick]
            total += cost[pick]
        if np.array_equal(new, medoids) or not total < best:
            break
        medoids, best = new, total
    return medoids, best, ran


@dataclass
class PAMAE(Clusterer):
    k: int
    num_samples: int = 5
    sample_size: int = 1000
    max_iter: int = 100
    refine_iters: int = 1
    pool_size: int = 2000
    inner: str = "fastpam"
    metric: Metric | None = None
    seed: int = 42

    def __post_init__(self):
        if self.refine_iters < 1:
            raise ValueError("refineIters must be at least 1")
        solver(self.inner, self.k, self.max_iter, self.metric, self.seed)

    def fit(self, df: DataFrame) -> KMedoidsModel:
        points = with_weights(df)
        model, _, rows = CLARA(self.k, self.num_samples, self.sample_size, self.max_iter, self.metric, self.inner, self.seed).seed_medoids(points)
        drawn = pool(points, self.pool_size, rows, self.seed + 1)
        medoids, _, ran = refine(points, model.medoids, drawn, self.metric, self.refine_iters)
        return KMedoidsModel(medoids, self.metric, ran)
