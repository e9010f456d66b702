"""Quality of a labelling: silhouette, Davies-Bouldin, Calinski-Harabasz, and label statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import FEATURES, NOISE, PREDICTION, WEIGHT
from ..functions.distance import Metric
from ..functions.weights import feature_column, weight_column
from .models import Model, literal
from .sampling import silhouette_sample

FULL_SILHOUETTE_ROWS = 50_000
METRICS = ("silhouette", "daviesBouldin", "calinskiHarabasz", "nClusters", "clusterSizes", "noiseFraction")


def labelled(model: Model, df: DataFrame) -> DataFrame:
    """[features, weight, prediction] with clean weights."""
    out = model.assign(df)
    return out.select(feature_column(out).alias(FEATURES), weight_column(out).alias(WEIGHT), F.col(PREDICTION).cast("int").alias(PREDICTION))


def label_stats(rows: DataFrame) -> DataFrame:
    """(prediction, rows, mass) for every label, noise too."""
    return rows.groupBy(PREDICTION).agg(F.count("*").alias("rows"), F.sum(WEIGHT).alias("mass"))


@dataclass(frozen=True)
class Moment:
    label: int
    center: np.ndarray
    mass: float
    distance: float
    square: float

    @property
    def spread(self) -> float:
        return self.distance / self.mass if self.mass > 0 else 0.0


def weighted_means(rows: DataFrame) -> DataFrame:
    """(prediction, mass, center): the weighted mean vector of every cluster, native: a row a coordinate meets in partial sums."""
    each = rows.select(PREDICTION, WEIGHT, F.posexplode(FEATURES).alias("at", "x"))
    sums = each.groupBy(PREDICTION, "at").agg(F.sum(F.col("x") * F.col(WEIGHT)).alias("s"), F.sum(WEIGHT).alias("mass"))
    ordered = sums.groupBy(PREDICTION).agg(F.max("mass").alias("mass"), F.array_sort(F.collect_list(F.struct("at", "s"))).alias("sums"))
    return ordered.select(PREDICTION, "mass", F.transform("sums", lambda x: F.try_divide(x["s"], F.col("mass"))).alias("center"))


def without_noise(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(PREDICTION) != NOISE)


def moments(model: Model, rows: DataFrame, metric: Metric) -> list[Moment]:
    """Centre, mass and distance sums of each cluster, noise left out. Centres are the model's prototypes if it has any, else means."""
    rows = without_noise(rows)
    centers = model.centers()
    if centers is None:
        centers = {r[PREDICTION]: np.array(r.center, float) for r in weighted_means(rows).collect() if r.mass > 0}
    # One row a cluster: a bounded table by the number of clusters, looked up as an expression.
    entries = [x for label, c in centers.items() for x in (F.lit(int(label)), literal(c))]
    if not entries:
        return []
    own = rows.withColumn("__center", F.try_element_at(F.create_map(*entries), F.col(PREDICTION))).withColumn("__d", metric.column(F.col(FEATURES), F.col("__center")))
    sums = own.groupBy(PREDICTION).agg(F.sum(WEIGHT).alias("mass"), F.sum(F.col(WEIGHT) * F.col("__d")).alias("d"), F.sum(F.col(WEIGHT) * F.col("__d") * F.col("__d")).alias("q"), F.count_if(F.col("__center").isNull()).alias("lost")).collect()
    if any(r.lost and r.mass > 0 for r in sums):
        raise ValueError("a label has no centre: the labelling changed between two passes")
    return [Moment(r[PREDICTION], np.array(centers[r[PREDICTION]]), r.mass or 0.0, r.d or 0.0, r.q or 0.0) for r in sorted(sums, key=lambda r: r[PREDICTION]) if not r.lost]


def davies_bouldin(found: list[Moment], metric: Metric) -> float:
    """Mean over the clusters of the worst ratio of spreads to the distance of centres; coincident centres are skipped."""
    if len(found) < 2:
        return 0.0
    c = np.array([m.center for m in found])
    s = np.array([m.spread for m in found])
    d = metric.block(c, c)
    np.fill_diagonal(d, 0.0)
    ratio = np.where(d > 0, (s[:, None] + s[None, :]) / np.where(d > 0, d, 1.0), 0.0)
    return float(ratio.max(axis=1).mean())


def calinski_harabasz(found: list[Moment], metric: Metric) -> float:
    """Between by within dispersion, each by its degrees of freedom."""
    k, mass = len(found), sum(m.mass for m in found)
    if k < 2 or mass <= k:
        return 0.0
    centre = sum(m.mass * m.center for m in found) / mass
    between = sum(m.mass * metric.block_ordinal(m.center[None, :], centre[None, :])[0, 0] if metric.square else m.mass * metric.block(m.center[None, :], centre[None, :])[0, 0] ** 2 for m in found)
    within = sum(m.square for m in found)
    if not np.isfinite(within) or within <= 0:
        return 1.0
    index = (between / (k - 1)) / (within / (mass - k))
    return float(index) if np.isfinite(index) else 0.0


@dataclass(frozen=True)
class Silhouette:
    score: float
    scored: int
    clusters: int
    unscored: int


def silhouette(rows: DataFrame, metric: Metric, sample_size: int = 0, seed: int = 42, masses: dict[int, float] | None = None, weighted: bool = True) -> Silhouette:
    """Mean silhouette of a bounded sample of the labelled rows.

    ``masses``: full-data mass by label, which decides what is a singleton. Rows with a coordinate or weight that
    isn't finite are left out and counted; a row whose cluster has nothing else in the sample can't be scored.
    """
    rows = without_noise(rows).where(F.col(WEIGHT) > 0)
    if masses is None:
        masses = {r[PREDICTION]: r.mass for r in label_stats(rows).collect()}
    sample = silhouette_sample(rows, sample_size, seed, sum(masses.get(k, 0.0) for k in masses if k != NOISE), weighted)
    finite = F.forall(FEATURES, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sample = sample.withColumn("__finite", F.coalesce(finite, F.lit(False)))
    own = sample.where("__finite").select(FEATURES, WEIGHT, PREDICTION).toArrow()
    n = own.num_rows
    labels = own[PREDICTION].to_numpy() if n else np.empty(0, int)
    kinds, slot = np.unique(labels, return_inverse=True)
    if len(kinds) < 2:
        return Silhouette(0.0, 0, len(kinds), n)
    x = np.array(own[FEATURES].to_pylist(), float)
    w = own[WEIGHT].to_numpy()
    mass = np.bincount(slot, w)
    full = np.array([masses.get(int(k), m) for k, m in zip(kinds, mass, strict=True)])
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((x, w, slot, mass, full))
    step = 256

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, w, slot, mass, full = shared.value
        for batch in batches:
            total = np.zeros(4)
            for block in batch.column(0).to_pylist():
                at = np.arange(block * step, min((block + 1) * step, len(x)))
                d = metric.block(x[at], x)
                t = np.stack([(d * (w * (slot == s))[None, :]).sum(axis=1) for s in range(len(mass))], axis=1)
                s = slot[at]
                self_share = np.minimum(1.0, w[at])
                rest = mass[s] - self_share
                with np.errstate(divide="ignore", invalid="ignore"):
                    a = (t[np.arange(len(at)), s] - self_share * d[np.arange(len(at)), at]) / rest
                    b = np.where(np.arange(len(mass))[None, :] == s[:, None], np.inf, t / mass[None, :])
                b = np.where(np.isfinite(b), b, np.inf).min(axis=1)
                top = np.maximum(a, b)
                value = np.where((top > 0) & np.isfinite(top), (b - a) / np.where(top > 0, top, 1.0), 0.0)
                alone = full[s] <= 1
                value = np.where(alone, 0.0, value)
                ok = alone | (rest > 0)
                total += (w[at] * value)[ok].sum(), w[at][ok].sum(), ok.sum(), (~ok).sum()
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=list("abcd"))

    blocks = -(-n // step)
    parts = np.array([tuple(r) for r in spark.range(0, blocks, 1, min(blocks, 64)).mapInArrow(scored, "a double, b double, c double, d double").collect()])
    shared.unpersist()
    s, m, ok, lost = parts.sum(axis=0)
    return Silhouette(float(s / m) if m > 0 else 0.0, int(ok), len(kinds), int(lost))


@dataclass
class Spec:
    metrics: tuple[str, ...] = ("silhouette", "nClusters", "clusterSizes", "noiseFraction")
    sample_size: int | None = 10_000
    seed: int = 42


@dataclass
class Result:
    values: dict = field(default_factory=dict)


def validate_metrics(names) -> None:
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"Unknown evaluation metric(s): {', '.join(unknown)}. Known: {', '.join(METRICS)}")


def evaluate(model: Model, df: DataFrame, metric: Metric, spec: Spec = Spec()) -> Result:
    """The asked-for metrics: one scan for label statistics, two for the moments, one for the silhouette."""
    validate_metrics(spec.metrics)
    rows, asked, out = labelled(model, df), set(spec.metrics), {}
    if asked & {"silhouette", "nClusters", "clusterSizes", "noiseFraction"}:
        stats = label_stats(rows).collect()
        masses = {r[PREDICTION]: r.mass for r in stats}
        total = sum(r["rows"] for r in stats)
        out["nClusters"] = sum(1 for r in stats if r[PREDICTION] is not None and r[PREDICTION] >= 0)
        if "clusterSizes" in asked:
            out["clusterSizes"] = {r[PREDICTION]: r["rows"] for r in stats}
        if "noiseFraction" in asked:
            out["noiseFraction"] = sum(r["rows"] for r in stats if r[PREDICTION] == NOISE) / total if total else 0.0
        if "silhouette" in asked:
            full = not spec.sample_size or spec.sample_size <= 0
            if full and total > FULL_SILHOUETTE_ROWS:
                raise ValueError(f"a full silhouette of {total} rows needs a sampleSize; at most {FULL_SILHOUETTE_ROWS} rows are scored without")
            got = silhouette(rows, metric, spec.sample_size or 0, spec.seed, masses, WEIGHT in df.columns)
            out |= {"silhouette": got.score, "silhouetteScoredPoints": got.scored, "silhouetteSampleClusters": got.clusters, "silhouetteUnscoredPoints": got.unscored}
    if asked & {"daviesBouldin", "calinskiHarabasz"}:
        found = moments(model, rows, metric)
        if "daviesBouldin" in asked:
            out["daviesBouldin"] = davies_bouldin(found, metric)
        if "calinskiHarabasz" in asked:
            out["calinskiHarabasz"] = calinski_harabasz(found, metric)
    return Result(out)
