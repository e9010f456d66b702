"""Runs a configuration: load, fit, evaluate, and write the result, of a failure too."""

from __future__ import annotations

import sys
import time
from datetime import UTC, datetime
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from ..operators.evaluate import Spec, evaluate
from ..operators.fold import dimension
from ..functions.weights import with_weights
from . import metrics as M
from .config import RunConfig
from .registry import ALGORITHMS, SOURCES
from .result import write

OK, FAILED, USAGE = 0, 2, 64
FRAMEWORK = "spark"


def session(config: RunConfig) -> SparkSession:
    builder = SparkSession.builder.appName(config.run_id)
    if config.master:
        builder = builder.master(config.master)
    for key, value in config.spark_config.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def await_executors(spark: SparkSession, most_s: float = 120) -> None:
    """Waits until as many executors as the configuration names are there; nothing to wait for in local mode."""
    conf = spark.sparkContext.getConf()
    cores, each = conf.get("spark.cores.max", None), conf.get("spark.executor.cores", None)
    if spark.sparkContext.master.startswith("local") or not cores or not each:
        return
    want, until = int(cores) // int(each), time.time() + most_s
    while len(M.executors(spark).workers) < want and time.time() < until:
        time.sleep(0.5)


def _now() -> str:
    return datetime.now(UTC).isoformat()


def run(config: RunConfig, spark: SparkSession | None = None) -> dict[str, Any]:
    """The result of a run. A failure anywhere, once the run has a name, is a result too."""
    started, began = _now(), time.time()
    base: dict[str, Any] = {
        "runId": config.run_id, "framework": FRAMEWORK, "profile": config.profile, "startedAtIso": started, "algorithm": config.algorithm.name, "algorithmParams": config.algorithm.params.echo(), "dataset": config.dataset.name,
        "datasetMetadata": {}, "sparkConf": dict(config.spark_config), "engineConf": {}, "experimentMetadata": dict(config.experiment_metadata),
    }
    try:
        own = spark or session(config)
        await_executors(own)
        own_part = _measured(config, own, base)
        return base | own_part | {"status": "ok", "finishedAtIso": _now(), "totalDurationMs": int((time.time() - began) * 1000)}
    except Exception as e:
        failed = {"status": "failed", "errorMessage": f"{type(e).__name__}: {e}"[:2000], "nRows": -1, "nPartitions": -1, "loadDurationMs": 0, "fitDurationMs": 0, "evalDurationMs": 0}
        return base | failed | {"finishedAtIso": _now(), "totalDurationMs": int((time.time() - began) * 1000)}


def _measured(config: RunConfig, spark: SparkSession, base: dict[str, Any]) -> dict[str, Any]:
    source = SOURCES.get(config.dataset.name).create(config.dataset.params)
    built = ALGORITHMS.get(config.algorithm.name)(config.algorithm.params)
    base["datasetMetadata"] = source.metadata()
    out: dict[str, Any] = {}
    durations: dict[str, int] = {}
    marks: list[tuple[M.Snapshot, M.Snapshot]] = []
    with M.DriverSampler(spark) as sampler:
        marks.append((sampler.snapshot(), M.executors(spark)))

        def phase(name: str, body):
            sampler.phase, began = name, time.time()
            try:
                return body()
            finally:
                durations[name] = int((time.time() - began) * 1000)
                sampler.phase = ""
                marks.append((sampler.snapshot(), M.executors(spark)))

        def load():
            data = source.load(spark).persist(StorageLevel.MEMORY_AND_DISK)
            rows = data.count()
            return data, rows, dimension(with_weights(data)) if rows else None

        data, rows, features = phase("load", load)
        try:
            model = phase("fit", lambda: built.clusterer.fit(data))
            spec = Spec(config.evaluation.metrics, config.evaluation.sample_size, config.evaluation.seed)
            out |= phase("eval", lambda: evaluate(model, data, built.metric, spec)).values
            partitions = data.rdd.getNumPartitions()
        finally:
            data.unpersist()
        windows = {p: sampler.window[p] for p in M.PHASES}
    if "clusterSizes" in out:
        out["clusterSizes"] = {str(k): v for k, v in out["clusterSizes"].items()}
    between = [(a[i].since(b[i])) for i in (0, 1) for b, a in zip(marks, marks[1:], strict=False)]
    driver, worker = dict(zip(M.PHASES, between[:3], strict=True)), dict(zip(M.PHASES, between[3:], strict=True))
    own, total = marks[-1][0].since(marks[0][0]), marks[-1][1].since(marks[0][1])
    peaks, mine = marks[-1][1].peaks(), marks[-1][0].peaks()
    fit_ms = sum(durations.values())
    whole = lambda by, key: {p: int(v[key]) for p, v in by.items()}
    out |= {
        "nRows": rows, "nPartitions": partitions, "nFeatures": features, "loadDurationMs": durations["load"], "fitDurationMs": durations["fit"], "evalDurationMs": durations["eval"],
        "iterationsRun": model.iterations_run, "reductionSize": model.reduction_size, "phaseDurationsMs": durations,
        "phaseCpuTimeNs": whole(worker, "cpu_ns"), "phaseGcTimeMs": whole(worker, "gc_ms"), "phaseMemoryGbHours": {p: M.gb_hours(v["heap_byte_s"]) for p, v in worker.items()},
        "phaseDriverCpuTimeNs": whole(driver, "cpu_ns"), "phaseDriverGcTimeMs": whole(driver, "gc_ms"), "phaseDriverMemoryGbHours": {p: M.gb_hours(v["heap_byte_s"]) for p, v in driver.items()},
        "phaseWindowDriverPeakHeapBytes": {p: w.peak_heap for p, w in windows.items()}, "phaseWindowDriverPeakDirectMemoryBytes": {p: w.peak_direct for p, w in windows.items()},
        "jvmGcTimeMs": int(total["gc_ms"]), "executorCpuTimeNs": int(total["cpu_ns"]), "peakExecutorMemoryBytes": peaks["peak_heap"], "totalExecutorMemoryBytes": peaks["total_heap"],
        "peakDirectMemoryBytes": peaks["peak_direct"], "totalDirectMemoryBytes": peaks["total_direct"], "avgCpuCoresBusy": M.average_cores(own["cpu_ns"] + total["cpu_ns"], fit_ms), "cpuCoreHours": M.core_hours(total["cpu_ns"]),
        "memoryGbHours": M.gb_hours(total["heap_byte_s"]), "driverCpuTimeNs": int(own["cpu_ns"]), "driverPeakHeapBytes": mine["peak_heap"], "driverGcTimeMs": int(own["gc_ms"]), "driverPeakDirectMemoryBytes": mine["peak_direct"],
        "driverCpuCoreHours": M.core_hours(own["cpu_ns"]), "driverMemoryGbHours": M.gb_hours(own["heap_byte_s"]),
    }
    return {k: v for k, v in out.items() if v is not None}


HELP = "usage: python -m lodestrata --config RUN.json"


def main(args: list[str]) -> int:
    if args in (["--help"], ["-h"]):
        print(HELP)
        return OK
    if len(args) != 2 or args[0] != "--config":
        print(HELP, file=sys.stderr)
        return USAGE
    config = RunConfig.from_file(args[1])
    result = run(config)
    print(write(result, config.output_dir))
    return OK if result["status"] == "ok" else FAILED
