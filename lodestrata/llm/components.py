"""Connected components of a table of links, by alternating large and small stars.

Each round points every node at the least node it knows of; the tables stay in the cluster, one written table a
round, and the rounds needed grow with the square of the logarithm of the longest path. Up to a counted number of
links they are joined on the driver instead: a dozen rounds of plans cost it more memory than the links do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u > v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the links, ascending, and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return nodes, nodes[root]


def connected_components(links: DataFrame, a: str, b: str, local_links: int = 500_000) -> DataFrame:
    """(node, component) for every node that a link names; the component is its least node. Loops and repeated links do no harm; links with a null end are left out."""
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = written(edges, "links")
    if edges.count() > local_links:
        edges = written(edges.distinct(), "links")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    if before[0] <= local_links:  # a checked bound
        nodes, least = least_nodes(*(c.to_numpy() for c in edges.select("u", "v").toArrow().columns))
        kind = edges.schema["u"].dataType.simpleString()
        found = edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(least, pa.int64())}))
        return written(found.select(*(F.col(c).cast(kind).alias(c) for c in found.columns)), "components")
    while before[0]:
        edges = written(_small(_large(edges)), "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    return written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
