"""Run configurations and their typed parameters."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any


class Params:
    """Reads typed values; what is missing or of another type is a ``ValueError`` that names it."""

    def __init__(self, values: dict[str, Any] | None):
        self.values = values or {}

    def _get(self, name: str, kind, default: Any, needed: bool) -> Any:
        if self.values.get(name) is None:
            if needed:
                raise ValueError(f"Missing required parameter: '{name}'")
            return default
        value = self.values[name]
        if kind is str and not isinstance(value, str) or kind is not str and (isinstance(value, (bool, str)) or not isinstance(value, (int, float)) or kind is int and value != int(value)):
            raise ValueError(f"Parameter '{name}' is not a {kind.__name__}: {value!r}")
        return kind(value)

    def int(self, name: str) -> int:
        return self._get(name, int, None, True)

    def int_opt(self, name: str, default: int | None = None) -> int | None:
        return self._get(name, int, default, False)

    long, long_opt = int, int_opt

    def double(self, name: str) -> float:
        return self._get(name, float, None, True)

    def double_opt(self, name: str, default: float | None = None) -> float | None:
        return self._get(name, float, default, False)

    def string(self, name: str) -> str:
        return self._get(name, str, None, True)

    def string_opt(self, name: str, default: str | None = None) -> str | None:
        return self._get(name, str, default, False)

    def echo(self) -> dict[str, str]:
        """Every parameter as text, by its JSON type."""
        return {k: v if isinstance(v, str) else json.dumps(v, separators=(",", ":")) for k, v in self.values.items()}


@dataclass
class Named:
    name: str
    params: Params


@dataclass
class EvaluationSpec:
    metrics: tuple[str, ...] = ("silhouette", "nClusters", "clusterSizes", "noiseFraction")
    sample_size: int | None = 10_000
    seed: int = 42


#: Profile and the master it sets; None inherits what the session has.
PROFILES: dict[str, str | None] = {"local": "local[*]", "cluster": None}


@dataclass
class RunConfig:
    run_id: str
    dataset: Named
    algorithm: Named
    profile: str = "local"
    evaluation: EvaluationSpec = field(default_factory=EvaluationSpec)
    spark_config: dict[str, str] = field(default_factory=dict)
    output_dir: str = ""
    experiment_metadata: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, doc: dict) -> RunConfig:
        for name in ("runId", "dataset", "algorithm"):
            if name not in doc:
                raise ValueError(f"Missing required parameter: '{name}'")
        spec = doc.get("evaluation") or {}
        default = EvaluationSpec()
        own = EvaluationSpec(tuple(spec.get("metrics", default.metrics)), spec.get("sampleSize", default.sample_size), spec.get("seed", default.seed))
        text = lambda d: {k: v if isinstance(v, str) else json.dumps(v) for k, v in (d or {}).items()}
        return cls(
            doc["runId"], Named(doc["dataset"]["type"], Params(doc["dataset"].get("params"))), Named(doc["algorithm"]["name"], Params(doc["algorithm"].get("params"))), doc.get("profile", "local"), own,
            text(doc.get("spark_config")), doc.get("outputDir") or os.path.join(os.getcwd(), "benchmark-results"), text(doc.get("experimentMetadata")),
        )

    @classmethod
    def from_file(cls, path: str) -> RunConfig:
        with open(path, encoding="utf-8") as f:
            return cls.of(json.load(f))

    @property
    def master(self) -> str | None:
        if self.profile.lower() not in PROFILES:
            raise ValueError(f"Unknown profile: '{self.profile}'. Known: {', '.join(sorted(PROFILES))}")
        return PROFILES[self.profile.lower()]
