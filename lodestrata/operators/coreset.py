"""Clustering on a lightweight coreset: a few weighted rows stand for all, a local solver does the rest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions.distance import Metric, nearest
from ..functions.geometry import EUCLIDEAN_GEOMETRY, Geometry
from ..functions.weights import with_weights
from .kmeans import converged, moved
from .models import Clusterer, CoresetModel
from .pam import solver
from .sampling import lightweight_coreset, local_weighted_top


@dataclass
class LocalLloyd:
    """k-means on rows in memory, the same rounds as the distributed fit."""

    k: int
    max_iter: int = 100
    eps: float = 1e-4
    seed: int = 42
    geometry: Geometry = EUCLIDEAN_GEOMETRY
    name = "kmeans"

    @property
    def fit_metric(self) -> Metric:
        return self.geometry.fit_metric

    @property
    def model_metric(self) -> Metric:
        return self.geometry.model_metric

    def iterate(self, points: np.ndarray, weights: np.ndarray, init: np.ndarray) -> tuple[np.ndarray, int]:
        centres = init
        for i in range(self.max_iter):
            at = nearest(self.fit_metric, points, centres)[0]
            sums = np.zeros((len(centres), points.shape[1] + 1))
            for j in range(points.shape[1]):
                sums[:, j] = np.bincount(at, weights * points[:, j], len(centres))
            sums[:, -1] = np.bincount(at, weights, len(centres))
            new = moved(centres, sums, self.geometry)
            done = converged(centres, new, self.eps, self.geometry)
            centres = new
            if done:
                return centres, i + 1
        return centres, self.max_iter

    def solve(self, points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, int]:
        own = self.geometry.project(points)
        return self.iterate(own, weights, local_weighted_top(own, weights, self.k, self.seed))


@dataclass
class LocalMedoids:
    k: int
    metric: Metric
    inner: str = "fastpam"
    max_iter: int = 100
    seed: int = 42
    name = "medoids"

    @property
    def fit_metric(self) -> Metric:
        return self.metric

    model_metric = fit_metric

    def solve(self, points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, int]:
        found = solver(self.inner, self.k, self.max_iter, self.metric, self.seed).fit_local(points, weights)
        return points[found.medoids], found.iterations


@dataclass
class Coreset(Clusterer):
    k: int
    m: int
    solver: LocalLloyd | LocalMedoids
    seed: int = 42

    def __post_init__(self):
        if self.k < 1 or self.m < self.k:
            raise ValueError("k must be at least 1 and m at least k")

    def fit(self, df: DataFrame) -> CoresetModel:
        geometry = getattr(self.solver, "geometry", EUCLIDEAN_GEOMETRY)
        points = geometry.prepare(with_weights(df))
        rows, weights, _, _ = lightweight_coreset(points, self.m, self.solver.fit_metric, self.seed)
        if len(rows) < self.k:
            raise ValueError(f"the coreset has {len(rows)} rows, fewer than k = {self.k}")
        prototypes, ran = self.solver.solve(rows, weights)
        model = CoresetModel(prototypes, self.solver.model_metric, ran, len(rows))
        model.requested_size, model.inner = self.m, self.solver.name
        return model
