"""Samples and reductions of a point set; none ever takes a prefix."""

from __future__ import annotations

import random
from collections.abc import Callable
from math import ceil, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import FEATURES, WEIGHT
from ..functions.distance import Metric
from ..functions.uniform import content_uniform
from .fold import dimension, fold
from .models import collected, literal

LEAST = float(np.nextafter(0, 1))


def ares_key(u: Column, weight: Column) -> Column:
    """The weighted reservoir's key u^(1/w); only for weights above 0."""
    return F.pow(u, F.lit(1.0) / weight)


def weighted_top_rows(points: DataFrame, k: int, u: Column) -> DataFrame:
    """k rows, each drawn with a chance that follows its weight; rows without weight are never drawn. u: a uniform number for each row."""
    # The logarithm of the reservoir's key has its order, and doesn't underflow where weights are small.
    scored = points.where(F.col(WEIGHT) > 0).withColumn("__key", F.log(u) / F.col(WEIGHT))
    return scored.orderBy(F.desc("__key")).limit(k).drop("__key")


def weighted_top(points: DataFrame, k: int, seed: int, u: Column | None = None) -> np.ndarray:
    """The features of the k rows; without ``u`` numbers are drawn row by row, and so depend on the partitioning."""
    rows = weighted_top_rows(points, k, F.rand(seed) if u is None else u).select(FEATURES).collect()
    if len(rows) < k:
        raise ValueError(f"dataset too small: {len(rows)} rows for k = {k}")
    return np.array([r[0] for r in rows])


def local_weighted_top(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The same for rows on the driver: greatest score first, the lower index on ties."""
    u = np.random.default_rng(seed).random(len(points))
    score = np.log(np.maximum(u, LEAST)) / np.maximum(weights, LEAST)
    return points[np.lexsort((np.arange(len(points)), -score))[:k]]


def truncated(rows: list, size: int, seed: int) -> list:
    """``size`` of the rows, shuffled first, so that scan order has no say."""
    out = list(rows)
    random.Random(seed).shuffle(out)
    return out[:size]


def multi_sample(points: DataFrame, samples: int, size: int, rows: int, seed: int, slack: float = 1.3, u: Callable[[int], Column] = F.rand) -> DataFrame:
    """(sample_id, all columns): independent samples of about ``slack * size`` rows, all drawn in one scan by the numbers that ``u`` gives for a seed.

    A set of at most ``size`` rows is itself the only sample.
    """
    if rows <= size:
        return points.select(F.lit(0).alias("sample_id"), *points.columns)
    return chance_samples(points, samples, slack * size / rows, seed, u)


def chance_samples(points: DataFrame, samples: int, chance: float, seed: int, u: Callable[[int], Column] = F.rand) -> DataFrame:
    """(sample_id, all columns): independent samples, each with every row by the same chance, all drawn in one scan."""
    trials = F.array(*(F.when(u(seed + s) < chance, F.lit(s)) for s in range(samples)))
    drawn = points.withColumn("__in", trials).withColumn("sample_id", F.explode(F.array_compact("__in")))
    return drawn.select("sample_id", *points.columns)


def pool(points: DataFrame, size: int, rows: int, seed: int) -> np.ndarray:
    """Uniformly drawn rows, all of them if there are no more than ``size``."""
    if size >= rows:
        return next(collected(points, FEATURES))
    drawn = next(collected(points.sample(False, min(1.0, 1.3 * size / rows), seed), FEATURES))
    return np.array(truncated(list(drawn), size, seed))


def candidate_rows(points: DataFrame, size: int, rows: int, u: Column) -> DataFrame:
    """``size`` of the ``rows`` rows, whatever their weights and order: those with the least numbers ``u``; ``__u`` and ``__at``, a row's place in the scan, are added."""
    chance = min(1.0, (size + 4 * sqrt(size) + 8) / max(1, rows))  # what can't be among the least isn't sorted
    return points.withColumn("__u", u).withColumn("__at", F.monotonically_increasing_id()).where(F.col("__u") < chance).orderBy("__u", "__at").limit(size)


def uniform_candidates(points: DataFrame, size: int, rows: int, seed: int, u: Column | None = None) -> np.ndarray:
    """The features of ``size`` rows in scan order; without ``u`` numbers are drawn row by row, and so depend on the partitioning."""
    features, at = collected(candidate_rows(points, size, rows, F.rand(seed) if u is None else u), FEATURES, "__at")
    return features[np.argsort(at, kind="stable")]


def candidate_count(fraction: float, rows: int) -> int:
    return max(1, min(rows, ceil(fraction * rows)))


def coreset_moments(points: DataFrame, metric: Metric) -> tuple[np.ndarray, float, float]:
    """Weighted mean, mass and dispersion (sum of weight by squared distance to the mean), in two passes."""
    d = dimension(points)
    sums = fold(points, d + 1, lambda x, w: np.append(w @ x, w.sum()))
    mass = float(sums[d])
    if not mass > 0:
        raise ValueError("total weight must be greater than 0")
    mean = sums[:d] / mass
    spread = float(fold(points, 1, lambda x, w: np.array([(w * metric.block(x, mean[None, :])[:, 0] ** 2).sum()]))[0])
    return mean, mass, spread


def inclusion(weight: Column, squared: Column, m: int, mass: float, dispersion: float) -> Column:
    """Chance of a row: half by its mass, half by its share of the dispersion; by mass alone where nothing is spread."""
    share = weight / mass if dispersion <= 0 else weight * (F.lit(1 / (2 * mass)) + squared / (2 * dispersion))
    return F.least(F.lit(1.0), F.lit(float(m)) * share)


def coreset_rows(points: DataFrame, m: int, metric: Metric, mean: np.ndarray, mass: float, dispersion: float, u: Column) -> DataFrame:
    """Rows kept independently by their chance, weights raised by its inverse. u: a uniform number for each row."""
    d = metric.column(F.col(FEATURES), literal(mean))
    chance = points.withColumn("__pi", inclusion(F.col(WEIGHT), d * d, m, mass, dispersion)).withColumn("__u", u)
    drawn = chance.where((F.col("__u") < F.col("__pi")) & (F.col("__pi") > 0))
    return drawn.withColumn(WEIGHT, F.col(WEIGHT) / F.col("__pi")).drop("__pi", "__u")


def lightweight_coreset(points: DataFrame, m: int, metric: Metric, seed: int, u: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(rows, weights, mass, dispersion) of a coreset; without ``u`` numbers are drawn row by row, and so depend on the partitioning."""
    mean, mass, spread = coreset_moments(points, metric)
    rows, weights = collected(coreset_rows(points, m, metric, mean, mass, spread, F.rand(seed) if u is None else u), FEATURES, WEIGHT)
    return rows, weights, mass, spread


def silhouette_sample(labelled: DataFrame, size: int, seed: int, total: float, weighted: bool, u: Column | None = None) -> DataFrame:
    """About ``size`` rows. Without weights a row is kept by its number; with them it gives as many copies of weight 1
    as its expected number, the fraction by its number. A set no larger than ``size`` stays as it is."""
    if size <= 0 or total <= size:
        return labelled
    u = content_uniform(F.col(FEATURES), F.col(WEIGHT), seed=seed) if u is None else u
    if not weighted:
        return labelled.where(u < size / total)
    expected = F.greatest(F.lit(0.0), F.least(F.col(WEIGHT) * size / total, F.lit(float(size))))
    copies = F.floor(expected) + F.when(u < expected - F.floor(expected), 1).otherwise(0)
    return labelled.withColumn("__copies", copies.cast("int")).withColumn(WEIGHT, F.explode(F.array_repeat(F.lit(1.0), F.col("__copies")))).drop("__copies")
