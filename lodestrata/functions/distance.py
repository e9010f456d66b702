"""Distances, each as a Column expression and as a numpy block kernel that agree to the last bit of their sums."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _squares(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def _cosine(a: Column, b: Column) -> Column:
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / F.when(both == 0, F.lit(1.0)).otherwise(both))


def _folded(x: np.ndarray, y: np.ndarray, term) -> np.ndarray:
    """Sum over the coordinates, one after the other, for all pairs of rows."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        out += term(x[:, j, None], y[None, :, j])
    return out


def block_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _folded(x, y, lambda a, b: a * b)


def _block_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)))
    step = np.empty_like(out)
    for j in range(x.shape[1]):
        np.subtract(x[:, j, None], y[None, :, j], out=step)
        np.multiply(step, step, out=step)
        out += step
    return out


def _block_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    both = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]
    return np.where(both == 0, 1.0, 1.0 - block_dot(x, y) / np.where(both == 0, 1.0, both))


@dataclass(frozen=True)
class Metric:
    """A distance. ``ordinal`` orders like it and is cheaper; ``square`` tells that it is the squared distance."""

    name: str
    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    ordinal: Callable[[Column, Column], Column]
    block_ordinal: Callable[[np.ndarray, np.ndarray], np.ndarray]
    square: bool = False

    def bound(self, radius: float) -> float:
        """The radius on the ordinal scale."""
        return radius * radius if self.square else radius

    def within(self, a: Column, b: Column, radius: float) -> Column:
        """d <= radius, the boundary included; NaN coordinates are outside."""
        d = self.ordinal(a, b)
        return ~F.isnan(d) & (d <= self.bound(radius))

    def up_to(self, a: Column, b: Column, bound: float) -> Column:
        """The distance where it is within ``bound``, else infinity."""
        d = self.column(a, b)
        return F.when(~F.isnan(d) & (d <= bound), d).otherwise(F.lit(float("inf")))

    def block_within(self, x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return self.block_ordinal(x, y) <= self.bound(radius)

    def distance(self, ordinal: np.ndarray) -> np.ndarray:
        return np.sqrt(ordinal) if self.square else ordinal


EUCLIDEAN = Metric("euclidean", lambda a, b: F.sqrt(_squares(a, b)), lambda x, y: np.sqrt(_block_squares(x, y)), _squares, _block_squares, True)
_manhattan = lambda a, b: _sum(a, b, lambda x, y: F.abs(x - y))
_block_manhattan = lambda x, y: _folded(x, y, lambda a, b: np.abs(a - b))
MANHATTAN = Metric("manhattan", _manhattan, _block_manhattan, _manhattan, _block_manhattan)
COSINE = Metric("cosine", _cosine, _block_cosine, _cosine, _block_cosine)
_sphere = lambda a, b: F.lit(1.0) - dot(a, b)
_block_sphere = lambda x, y: 1.0 - block_dot(x, y)
#: For vectors of length one; not to be chosen by name.
UNIT_SPHERE = Metric("unit_sphere", _sphere, _block_sphere, _sphere, _block_sphere)


def nearest(metric: Metric, x: np.ndarray, prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest prototype, the lowest on ties, and its ordinal distance; NaN never wins."""
    d = metric.block_ordinal(x, prototypes)
    d = np.where(np.isnan(d), np.inf, d)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]
