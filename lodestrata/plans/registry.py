"""Names to things: algorithms, distances, geometries and sources, whatever their case."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..functions.distance import COSINE, EUCLIDEAN, MANHATTAN, Metric
from ..functions.geometry import EUCLIDEAN_GEOMETRY, SPHERICAL_GEOMETRY
from ..operators.bisecting import BisectingKMeans
from ..operators.coreset import Coreset, LocalLloyd, LocalMedoids
from ..operators.dbscan import DBSCANpp
from ..operators.kmeans import BreathingKMeans, KMeans
from ..operators.medoids import CLARA, PAMAE
from ..operators.models import Clusterer
from ..sources import ParquetSource, SyntheticSource
from .config import Params


class Registry:
    def __init__(self, kind: str, entries: dict[str, Any]):
        self.kind, self.entries = kind, {k.lower(): v for k, v in entries.items()}

    def get(self, name: str) -> Any:
        if name.lower() not in self.entries:
            raise ValueError(f"Unknown {self.kind}: '{name}'. Known: {', '.join(sorted(self.entries))}")
        return self.entries[name.lower()]


@dataclass
class Built:
    """A clusterer and the metric its labels are judged by."""

    clusterer: Clusterer
    metric: Metric


DISTANCES = Registry("distance", {m.name: m for m in (EUCLIDEAN, MANHATTAN, COSINE)})
GEOMETRIES = Registry("geometry", {g.name: g for g in (EUCLIDEAN_GEOMETRY, SPHERICAL_GEOMETRY)})
SOURCES = Registry("data source", {s.type_name: s for s in (ParquetSource, SyntheticSource)})


def _distance(p: Params) -> Metric:
    name = p.string_opt("distance")
    if name is None:
        raise ValueError("Missing required 'distance' parameter")
    return DISTANCES.get(name)


def _geometry(p: Params):
    return GEOMETRIES.get(p.string_opt("geometry", "euclidean"))


def _kmeans(p: Params) -> Built:
    g, refine = _geometry(p), p.string_opt("refine", "none").lower()
    common = {"max_iter": p.int_opt("maxIter", 100), "eps": p.double_opt("eps", 1e-4), "seed": p.long_opt("seed", 42), "geometry": g}
    if refine == "none":
        return Built(KMeans(p.int("k"), **common), g.model_metric)
    if refine == "breathing":
        return Built(BreathingKMeans(p.int("k"), p.int_opt("m0", 5), max_cycles=p.int_opt("maxCycles", 100), **common), g.model_metric)
    raise ValueError(f"Unknown refine mode: '{refine}'. Known: breathing, none")


def _bisecting(p: Params) -> Built:
    g = _geometry(p)
    return Built(BisectingKMeans(p.int("k"), p.int_opt("maxIter", 20), p.double_opt("eps", 1e-4), p.long_opt("seed", 42), g, p.int_opt("trials", 1), p.string_opt("select", "cost").lower()), g.model_metric)


def _sampled(p: Params) -> dict:
    return {"k": p.int("k"), "num_samples": p.int_opt("numSamples", 5), "sample_size": p.int_opt("sampleSize", 1000), "max_iter": p.int_opt("maxIter", 100), "inner": p.string_opt("inner", "fastpam"), "seed": p.long_opt("seed", 42), "metric": _distance(p)}


def _clara(p: Params) -> Built:
    return Built(CLARA(**_sampled(p)), _distance(p))


def _pamae(p: Params) -> Built:
    return Built(PAMAE(**_sampled(p), refine_iters=p.int_opt("refineIters", 1), pool_size=p.int_opt("poolSize", 2000)), _distance(p))


def _dbscan(p: Params) -> Built:
    mode = p.string_opt("assign", "eps").lower()
    if mode not in ("eps", "closest"):
        raise ValueError(f"Unknown assign mode: '{mode}'. Known: closest, eps")
    return Built(DBSCANpp(p.double("eps"), p.double("minPts"), p.double("coreSampleFraction"), p.string_opt("sampling", "uniform"), mode == "eps", _distance(p), p.long_opt("seed", 42)), _distance(p))


def _coreset(p: Params) -> Built:
    inner, k, seed, rounds = p.string_opt("inner", "kmeans").lower(), p.int("k"), p.long_opt("seed", 42), p.int_opt("maxIter", 100)
    if inner == "kmeans":
        own = LocalLloyd(k, rounds, p.double_opt("eps", 1e-4), seed, _geometry(p))
    elif inner == "medoids":
        own = LocalMedoids(k, _distance(p), p.string_opt("innerSolver", "fastpam"), rounds, seed)
    else:
        raise ValueError(f"Unknown inner algorithm: '{inner}'. Known: kmeans, medoids")
    return Built(Coreset(k, p.int("m"), own, seed), own.model_metric)


ALGORITHMS = Registry("algorithm", {"kmeans": _kmeans, "bisectingkmeans": _bisecting, "clara": _clara, "pamae": _pamae, "dbscanpp": _dbscan, "coreset": _coreset})
