"""What a run costs: CPU, memory and garbage collection of the driver's processes, sampled in the background.

A JVM plugin can't be written in Python; executor figures come from Spark's own status store, which every executor
reports to, and the driver's from the JVM's beans and the process tree. Counters are told as differences since a
baseline, peaks are not rebased, and a phase's figures tile the run.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from dataclasses import dataclass, field

import psutil
from pyspark.sql import SparkSession

PHASES = ("load", "fit", "eval")
COUNTERS = ("cpu_ns", "gc_ms", "heap_byte_s")


@dataclass
class Reading:
    """Cumulative counters, and peaks so far, of one worker."""

    cpu_ns: int = 0
    gc_ms: int = 0
    heap_byte_s: float = 0.0
    peak_heap: int = 0
    peak_direct: int = 0


@dataclass
class Snapshot:
    """Readings by worker; a worker that started again, or late, counts from nothing."""

    workers: dict[str, Reading] = field(default_factory=dict)

    def since(self, base: Snapshot) -> dict[str, float]:
        out = dict.fromkeys(COUNTERS, 0.0)
        for name, now in self.workers.items():
            before = base.workers.get(name, Reading())
            for c in COUNTERS:
                out[c] += max(0, getattr(now, c) - getattr(before, c))
        return out

    def peaks(self) -> dict[str, int]:
        heap, direct = ([getattr(r, k) for r in self.workers.values()] for k in ("peak_heap", "peak_direct"))
        return {"peak_heap": max(heap, default=0), "total_heap": sum(heap), "peak_direct": max(direct, default=0), "total_direct": sum(direct)}


class DriverSampler:
    """Samples the driver every ``interval`` seconds; ``phase`` sets where window peaks go."""

    def __init__(self, spark: SparkSession, interval: float = 0.2):
        self.jvm, self.interval = spark.sparkContext._jvm, interval
        self.process, self.phase = psutil.Process(), ""
        self.reading = Reading()
        self.window: dict[str, Reading] = defaultdict(Reading)
        self.lock, self.stopped = threading.Lock(), threading.Event()
        self.thread = threading.Thread(target=self._loop, daemon=True)

    def __enter__(self) -> DriverSampler:
        self.tick()
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stopped.set()
        self.thread.join()

    def _loop(self) -> None:
        while not self.stopped.wait(self.interval):
            self.tick()

    def _direct(self) -> int:
        """Bytes of direct buffers, as Spark's own executor metrics read them."""
        metric = getattr(getattr(self.jvm.org.apache.spark.metrics, "DirectPoolMemory$"), "MODULE$")
        return int(metric.getMetricValue(self.jvm.org.apache.spark.SparkEnv.get().memoryManager()))

    def tick(self) -> None:
        factory = self.jvm.java.lang.management.ManagementFactory
        heap = factory.getMemoryMXBean().getHeapMemoryUsage().getUsed()
        gc = sum(max(0, b.getCollectionTime()) for b in factory.getGarbageCollectorMXBeans())
        direct = self._direct()
        cpu = 0.0
        for p in [self.process, *self.process.children(recursive=True)]:
            try:
                cpu += sum(p.cpu_times()[:2])
            except psutil.Error:
                continue
        with self.lock:
            r = self.reading
            r.cpu_ns, r.gc_ms = int(cpu * 1e9), int(gc)
            r.heap_byte_s += heap * self.interval
            r.peak_heap, r.peak_direct = max(r.peak_heap, heap), max(r.peak_direct, direct)
            if self.phase:
                w = self.window[self.phase]
                w.peak_heap, w.peak_direct = max(w.peak_heap, heap), max(w.peak_direct, direct)

    def snapshot(self) -> Snapshot:
        self.tick()
        with self.lock:
            return Snapshot({"driver": Reading(**vars(self.reading))})


def _stage_cpu_ns(spark: SparkSession, store) -> int:
    """CPU time of all tasks of all stages that the status store still has."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).executorCpuTime() for i in range(stages.size()))


def executors(spark: SparkSession, driver: bool = False) -> Snapshot:
    """CPU time, collections, peak heap and peak direct memory of each executor, as the status store has them; none in local mode.

    Spark counts the CPU time of tasks by stage: it is shared out by the time that each executor's tasks took.
    """
    out = Snapshot()
    store = spark.sparkContext._jsc.sc().statusStore()
    listed = store.executorList(False)
    found = [e for e in (listed.apply(i) for i in range(listed.size())) if driver or e.id() != "driver"]
    cpu = _stage_cpu_ns(spark, store) if found else 0
    busy = sum(e.totalDuration() for e in found)
    for e in found:
        peaks = e.peakMemoryMetrics()
        heap, direct = (int(peaks.get().getMetricValue(name)) if peaks.isDefined() else 0 for name in ("JVMHeapMemory", "DirectPoolMemory"))
        own = cpu * e.totalDuration() / busy if busy else 0
        out.workers[e.id()] = Reading(int(own), int(e.totalGCTime()), heap * e.totalDuration() / 1e3, heap, direct)
    return out


def core_hours(ns: float) -> float:
    return ns / 3.6e12


def gb_hours(byte_seconds: float) -> float:
    return byte_seconds / (1024**3 * 3600)


def average_cores(ns: float, ms: float) -> float | None:
    return ns / (ms * 1e6) if ms > 0 else None
