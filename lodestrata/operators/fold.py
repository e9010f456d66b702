"""Array-valued aggregation: each partition folds its Arrow batches into one array, and the arrays are summed.

Partial arrays meet in the order of their partitions, so that a sum has the same bits every time. With very many
partitions they are first summed in at most ``GROUPS`` groups of neighbours; the driver never gets more arrays than
that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import FEATURES, WEIGHT

GROUPS = 256


def matrix(column: pa.Array) -> np.ndarray:
    """A list<double> column as rows of equal length."""
    rows = len(column)
    if not rows:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % rows:
        raise ValueError("feature vectors differ in length")
    return flat.astype(np.float64, copy=False).reshape(rows, -1)


def fold(points: DataFrame, length: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of ``step(features, weights)``, each an array of ``length`` doubles."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                total += step(matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["part", "total"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, np.zeros(length)
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first = part if first is None else first
                total += own.values.to_numpy()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["part", "total"])

    schema = "part int, total array<double>"
    parts = points.select(FEATURES, WEIGHT)
    many = parts.rdd.getNumPartitions()
    folded = parts.mapInArrow(partial, schema)
    if many > GROUPS:
        folded = folded.repartitionByRange(GROUPS, "part").sortWithinPartitions("part").mapInArrow(summed, schema)
    rows = folded.toArrow()
    order = np.argsort(rows["part"].to_numpy(), kind="stable")
    total = np.zeros(length)
    for i in order.tolist():
        total += rows["total"][i].values.to_numpy()
    return total


def dimension(points: DataFrame) -> int:
    row = points.select(F.size(FEATURES)).first()
    if row is None:
        raise ValueError("dataset is empty")
    return row[0]
