"""Geometries: how a fit prepares its rows, measures, moves centres, and prices a point."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import FEATURES
from .distance import COSINE, EUCLIDEAN, UNIT_SPHERE, Metric, norm


def l2_normalized(v: Column) -> Column:
    """v / |v|; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def normalize(v: np.ndarray) -> np.ndarray:
    """The numpy twin, for one vector or the rows of a matrix."""
    n = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return np.where(n == 0, v, v / np.where(n == 0, 1.0, n))


@dataclass(frozen=True)
class Geometry:
    name: str
    fit_metric: Metric
    model_metric: Metric
    transforms: bool

    def prepare(self, df: DataFrame) -> DataFrame:
        return df.withColumn(FEATURES, l2_normalized(F.col(FEATURES))) if self.transforms else df

    def project(self, centre: np.ndarray) -> np.ndarray:
        return normalize(centre) if self.transforms else centre

    def cost(self, ordinal: np.ndarray) -> np.ndarray:
        """A point's price from its ordinal distance: the square for Euclid, the distance itself on the sphere."""
        return ordinal

    def cost_column(self, a: Column, b: Column, metric: Metric | None = None) -> Column:
        m = metric or self.fit_metric
        return m.ordinal(a, b)

    def cost_to_distance(self, mean_cost: float) -> float:
        return mean_cost if self.transforms else float(np.sqrt(mean_cost))


EUCLIDEAN_GEOMETRY = Geometry("euclidean", EUCLIDEAN, EUCLIDEAN, False)
SPHERICAL_GEOMETRY = Geometry("spherical", UNIT_SPHERE, COSINE, True)
