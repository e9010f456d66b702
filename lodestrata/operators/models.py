"""Fitted models: each labels a DataFrame, batch or streaming, by a projection."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import FEATURES, NOISE, PREDICTION
from ..functions.distance import Metric, nearest
from ..functions.weights import feature_column
from .fold import matrix


def labelled_by(features: Column, label) -> Column:
    """An int column from ``label(matrix) -> labels``, computed batch by batch and never twice for a row."""

    @F.arrow_udf("int")
    def labels(column: pa.Array) -> pa.Array:
        return pa.array(label(matrix(column)).astype(np.int32)) if len(column) else pa.array([], pa.int32())

    return labels.asNondeterministic()(features)


def literal(vector: np.ndarray) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


class Model(ABC):
    """Labels points; ``iterations_run`` and ``reduction_size`` tell what the fit did, where it applies."""

    iterations_run: int | None = None
    reduction_size: int | None = None

    @abstractmethod
    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with its prediction."""

    def centers(self) -> dict[int, np.ndarray] | None:
        """Centres by label where the model has prototypes."""
        return None


class Clusterer(ABC):
    """Fits a model. The caller owns the cache: ``fit`` persists only what it computes itself, and releases it."""

    @abstractmethod
    def fit(self, df: DataFrame) -> Model: ...


class PrototypeModel(Model):
    """The nearest prototype's index, the lowest on ties."""

    def __init__(self, prototypes, metric: Metric, iterations_run: int | None = None, reduction_size: int | None = None):
        self.prototypes = np.array(prototypes, float)
        if not len(self.prototypes):
            raise ValueError("at least one prototype is needed")
        self.metric, self.iterations_run, self.reduction_size = metric, iterations_run, reduction_size

    def assign(self, df: DataFrame) -> DataFrame:
        prototypes, metric = self.prototypes, self.metric
        return df.withColumn(PREDICTION, labelled_by(feature_column(df), lambda x: nearest(metric, x, prototypes)[0]))

    def expression(self, features: Column) -> Column:
        """The same label as one native expression, for few prototypes."""
        pairs = [F.struct(self.metric.ordinal(features, literal(p)).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(self.prototypes)]
        return F.array_min(F.array(*pairs))["i"]

    def centers(self) -> dict[int, np.ndarray]:
        return dict(enumerate(self.prototypes))


class KMeansModel(PrototypeModel):
    @property
    def centroids(self) -> np.ndarray:
        return self.prototypes


class KMedoidsModel(PrototypeModel):
    @property
    def medoids(self) -> np.ndarray:
        return self.prototypes


class CoresetModel(PrototypeModel):
    requested_size: int = 0
    inner: str = ""


@dataclass
class Node:
    """A cluster or a split of a cluster tree; leaves carry ids from left to right."""

    center: np.ndarray
    left: Node | None = None
    right: Node | None = None
    label: int = -1


def leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else leaves(node.left) + leaves(node.right)


class BisectingKMeansModel(Model):
    """Descends from the root to the nearer child, left on ties."""

    def __init__(self, root: Node, metric: Metric, iterations_run: int | None = None):
        self.root, self.metric, self.iterations_run = root, metric, iterations_run
        for i, leaf in enumerate(leaves(root)):
            leaf.label = i

    @property
    def cluster_centroids(self) -> np.ndarray:
        return np.array([n.center for n in leaves(self.root)])

    @property
    def num_clusters(self) -> int:
        return len(leaves(self.root))

    def label(self, x: np.ndarray, node: Node | None = None) -> np.ndarray:
        node = node or self.root
        if node.left is None:
            return np.full(len(x), node.label)
        d = self.metric.block_ordinal(x, np.array([node.left.center, node.right.center]))
        left = d[:, 0] <= d[:, 1]
        out = np.empty(len(x), int)
        out[left], out[~left] = self.label(x[left], node.left), self.label(x[~left], node.right)
        return out

    def assign(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTION, labelled_by(feature_column(df), self.label))

    def expression(self, features: Column, node: Node | None = None) -> Column:
        node = node or self.root
        if node.left is None:
            return F.lit(node.label)
        d = [self.metric.ordinal(features, literal(n.center)) for n in (node.left, node.right)]
        return F.when(d[0] <= d[1], self.expression(features, node.left)).otherwise(self.expression(features, node.right))


class CoreLabelModel(Model):
    """The cluster of the nearest core point, the first on ties; beyond eps noise, unless the closest is asked for.

    Cores travel in chunks of bounded size: each chunk is one Arrow projection that carries the best so far.
    """

    def __init__(self, core_points, core_labels, eps: float, metric: Metric, require_within_eps: bool = True, chunk: int = 50_000):
        self.core_points, self.core_labels = np.array(core_points, float), np.array(core_labels, int)
        self.eps, self.metric, self.require_within_eps, self.chunk = eps, metric, require_within_eps, chunk
        self.reduction_size = len(self.core_points)

    @property
    def number_of_clusters(self) -> int:
        return len(set(self.core_labels.tolist()))

    def assign(self, df: DataFrame) -> DataFrame:
        if not len(self.core_points):
            return df.withColumn(PREDICTION, F.lit(NOISE))
        spark, best = df.sparkSession, F.lit(None).cast("struct<d: double, label: int>")
        for at in range(0, len(self.core_points), self.chunk):
            part = spark.sparkContext.broadcast((self.core_points[at : at + self.chunk], self.core_labels[at : at + self.chunk]))
            best = self._nearer(part)(feature_column(df), best)
        out = df.withColumn("__best", best)
        bound = self.metric.bound(self.eps)
        label = F.when(F.col("__best.d") <= bound, F.col("__best.label")).otherwise(F.lit(NOISE)) if self.require_within_eps else F.coalesce("__best.label", F.lit(NOISE))
        return out.withColumn(PREDICTION, label).drop("__best")

    def _nearer(self, part):
        metric = self.metric

        @F.arrow_udf("struct<d: double, label: int>")
        def nearer(features: pa.Array, best: pa.Array) -> pa.Array:
            cores, labels = part.value
            x = matrix(features)
            own_d, own_label = np.full(len(features), np.inf), np.full(len(features), NOISE)
            if len(features):
                if best.null_count < len(best):
                    own_d, own_label = (best.field(i).to_numpy(zero_copy_only=False).copy() for i in (0, 1))
                for a in range(0, len(x), 1024):
                    at, d = nearest(metric, x[a : a + 1024], cores)
                    better = d < own_d[a : a + 1024]
                    own_d[a : a + 1024][better], own_label[a : a + 1024][better] = d[better], labels[at[better]]
            return pa.StructArray.from_arrays([pa.array(own_d, pa.float64()), pa.array(own_label.astype(np.int32))], ["d", "label"])

        return nearer.asNondeterministic()


class LabelColumnModel(Model):
    """Takes labels from a column, so that evaluators can score any labelling."""

    def __init__(self, column: str = "__label"):
        self.column = column

    def assign(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTION, F.col(self.column).cast("int"))


def collected(points: DataFrame, *columns: str) -> Iterator[np.ndarray]:
    """Columns of a bounded frame on the driver, features as a matrix."""
    rows = points.select(*columns).toArrow()
    for c in columns:
        column = rows[c].combine_chunks()
        yield matrix(column) if c == FEATURES else column.to_numpy(zero_copy_only=False)


def nearest_ordinals(features: Column, prototypes: np.ndarray, metric: Metric, n: int) -> Column:
    """The ordinal distances to the n nearest prototypes, the nearest first, as an expression for few prototypes."""
    return F.slice(F.array_sort(F.array(*(metric.ordinal(features, literal(p)) for p in prototypes))), 1, n)
