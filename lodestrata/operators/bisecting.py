"""Bisecting k-means: splits one leaf at a time on a cached frame that carries each row's leaf."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import FEATURES
from ..functions.geometry import EUCLIDEAN_GEOMETRY, Geometry
from ..functions.weights import with_weights
from .fold import fold
from .kmeans import KMeans, mean_of
from .models import BisectingKMeansModel, Clusterer, Node, labelled_by

SELECTIONS = ("cost", "size")


@dataclass
class Leaf:
    node: Node
    points: DataFrame
    rows: float
    mass: float
    cost: float
    stuck: bool = False


def leaf_stats(points: DataFrame, centre: np.ndarray, geometry: Geometry) -> tuple[float, float, float]:
    """Rows, mass and cost around a centre, in one pass."""
    metric = geometry.fit_metric
    return tuple(fold(points, 3, lambda x, w: np.array([len(x), w.sum(), (w * geometry.cost(metric.block_ordinal(x, centre[None, :])[:, 0])).sum()])).tolist())


def split_cost(points: DataFrame, pair: np.ndarray, geometry: Geometry) -> float:
    """Cost of the points at the nearer of two centres."""
    metric = geometry.fit_metric
    return float(fold(points, 1, lambda x, w: np.array([(w * geometry.cost(metric.block_ordinal(x, pair).min(axis=1))).sum()]))[0])


@dataclass
class BisectingKMeans(Clusterer):
    k: int
    max_iter: int = 20
    eps: float = 1e-4
    seed: int = 42
    geometry: Geometry = EUCLIDEAN_GEOMETRY
    trials: int = 1
    select: str = "cost"

    def __post_init__(self):
        if self.k < 1 or self.trials < 1:
            raise ValueError("k and trials must be at least 1")
        if self.select not in SELECTIONS:
            raise ValueError(f"Unknown leaf selection: '{self.select}'. Known: {', '.join(SELECTIONS)}")

    def fit(self, df: DataFrame) -> BisectingKMeansModel:
        g = self.geometry
        held: list[DataFrame] = []

        def cached(frame: DataFrame) -> DataFrame:
            held.append(frame.persist(StorageLevel.MEMORY_AND_DISK))
            return frame

        try:
            points = g.prepare(with_weights(df))
            points = cached(points) if g.transforms else points
            root = Node(g.project(mean_of(points)[0]))
            all_leaves = [Leaf(root, points, *leaf_stats(points, root.center, g))]
            if all_leaves[0].rows < self.k:
                raise ValueError(f"dataset too small: {int(all_leaves[0].rows)} rows for k = {self.k}")
            splits = rounds = 0
            while len(all_leaves) < self.k:
                able = [i for i, x in enumerate(all_leaves) if not x.stuck and x.rows >= 2 and x.cost > 0]
                if not able:
                    break
                at = max(able, key=lambda i: (all_leaves[i].cost if self.select == "cost" else all_leaves[i].mass, -i))
                leaf = all_leaves[at]
                pair, ran = self._split(leaf.points, splits)
                rounds += ran
                labelled = cached(leaf.points.withColumn("__side", labelled_by(F.col(FEATURES), lambda x, p=pair: (g.model_metric.block_ordinal(x, p)[:, 0] > g.model_metric.block_ordinal(x, p)[:, 1]).astype(int))))
                sides = [labelled.where(F.col("__side") == s).drop("__side") for s in (0, 1)]
                stats = [leaf_stats(side, centre, g) for side, centre in zip(sides, pair, strict=True)]
                if not all(s[0] for s in stats):
                    leaf.stuck = True
                    continue
                leaf.node.left, leaf.node.right = Node(pair[0]), Node(pair[1])
                all_leaves[at : at + 1] = [Leaf(n, p, *s) for n, p, s in zip((leaf.node.left, leaf.node.right), sides, stats, strict=True)]
                splits += 1
        finally:
            for frame in held:
                frame.unpersist()
        return BisectingKMeansModel(root, g.model_metric, rounds)

    def _split(self, points: DataFrame, splits: int) -> tuple[np.ndarray, int]:
        """The cheapest of the trials' pairs, the first on ties, and the rounds of all trials."""
        best, least, rounds = None, np.inf, 0
        for trial in range(self.trials):
            model = KMeans(2, self.max_iter, self.eps, self.seed + splits * self.trials + trial, self.geometry).fit(points)
            rounds += model.iterations_run
            cost = split_cost(points, model.centroids, self.geometry) if self.trials > 1 else 0.0
            if best is None or cost < least:
                best, least = model.centroids, cost
        return best, rounds
