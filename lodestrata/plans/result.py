"""Run results: one flat document a run, of a closed schema, written whole or not at all."""

from __future__ import annotations

import json
import math
import os
from typing import Any

#: The fields of a result by type; those of REQUIRED are in every result.
REQUIRED = "runId framework profile startedAtIso finishedAtIso status algorithm algorithmParams dataset datasetMetadata nRows nPartitions loadDurationMs fitDurationMs evalDurationMs totalDurationMs".split()
STRINGS = "runId framework profile startedAtIso finishedAtIso status errorMessage algorithm dataset".split()
STRING_MAPS = "algorithmParams datasetMetadata sparkConf engineConf experimentMetadata".split()
INTEGERS = (
    "nRows nPartitions nFeatures loadDurationMs fitDurationMs evalDurationMs totalDurationMs jvmGcTimeMs executorCpuTimeNs peakExecutorMemoryBytes totalExecutorMemoryBytes peakDirectMemoryBytes totalDirectMemoryBytes "
    "driverCpuTimeNs driverPeakHeapBytes driverGcTimeMs driverPeakDirectMemoryBytes iterationsRun reductionSize nClusters silhouetteScoredPoints silhouetteSampleClusters silhouetteUnscoredPoints"
).split()
NUMBERS = "avgCpuCoresBusy cpuCoreHours memoryGbHours driverCpuCoreHours driverMemoryGbHours noiseFraction silhouette daviesBouldin calinskiHarabasz".split()
INTEGER_MAPS = (
    "phaseDurationsMs phaseCpuTimeNs phaseGcTimeMs phaseDriverCpuTimeNs phaseDriverGcTimeMs phaseWindowPeakExecutorMemoryBytes phaseWindowTotalExecutorMemoryBytes phaseWindowPeakDirectMemoryBytes "
    "phaseWindowTotalDirectMemoryBytes phaseWindowDriverPeakHeapBytes phaseWindowDriverPeakDirectMemoryBytes clusterSizes"
).split()
NUMBER_MAPS = "phaseMemoryGbHours phaseDriverMemoryGbHours".split()


def problems(result: dict[str, Any]) -> list[str]:
    """What keeps a result from the schema."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    tests = {
        **dict.fromkeys(STRINGS, lambda v: isinstance(v, str)), **dict.fromkeys(INTEGERS, whole), **dict.fromkeys(NUMBERS, number),
        **dict.fromkeys(STRING_MAPS, lambda v: isinstance(v, dict) and all(isinstance(x, str) for x in v.values())),
        **dict.fromkeys(INTEGER_MAPS, lambda v: isinstance(v, dict) and all(map(whole, v.values()))), **dict.fromkeys(NUMBER_MAPS, lambda v: isinstance(v, dict) and all(map(number, v.values()))),
    }
    found = [f"missing: {k}" for k in REQUIRED if k not in result]
    found += [f"unknown: {k}" for k in result if k not in tests]
    found += [f"wrong type: {k}" for k, v in result.items() if k in tests and not tests[k](v)]
    return found + (["status"] if result.get("status") not in ("ok", "failed") else [])


def serialized(result: dict[str, Any]) -> str:
    """One line of JSON; what is None is left out, and no number is other than finite."""
    return json.dumps({k: v for k, v in result.items() if v is not None}, separators=(",", ":"), allow_nan=False)


def write(result: dict[str, Any], directory: str) -> str:
    """<directory>/<runId>.json, by way of a hidden file that takes its name at once."""
    os.makedirs(directory, exist_ok=True)
    path, hidden = os.path.join(directory, f"{result['runId']}.json"), os.path.join(directory, f".{result['runId']}.json.tmp")
    with open(hidden, "w", encoding="utf-8") as f:
        f.write(serialized(result))
    os.replace(hidden, path)
    return path
