import json
import os

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.models import PrototypeModel
from lodestrata.functions.distance import EUCLIDEAN
from lodestrata.plans import metrics as M
from lodestrata.plans import result as R
from lodestrata.plans.config import Params, RunConfig
from lodestrata.plans.registry import ALGORITHMS, DISTANCES
from lodestrata.plans.runner import main, run
from lodestrata.streaming import labelled_stream

BASE = {"runId": "t", "profile": "local", "dataset": {"type": "synthetic-5mix-3d", "params": {"numPoints": 600, "numPartitions": 2}}}
ALL = list(("silhouette", "daviesBouldin", "calinskiHarabasz", "nClusters", "clusterSizes", "noiseFraction"))


@pytest.mark.parametrize(
    "name,params",
    [
        ("kmeans", {"k": 5, "maxIter": 5}), ("KMeans", {"k": 4, "maxIter": 3, "refine": "breathing", "m0": 1, "maxCycles": 1}), ("kmeans", {"k": 4, "geometry": "spherical", "maxIter": 4}),
        ("bisectingkmeans", {"k": 3, "maxIter": 4, "select": "size"}), ("clara", {"k": 4, "numSamples": 2, "sampleSize": 120, "distance": "manhattan"}),
        ("pamae", {"k": 4, "numSamples": 2, "sampleSize": 120, "poolSize": 100, "distance": "euclidean", "inner": "fasterpam"}), ("dbscanpp", {"eps": 3.0, "minPts": 5, "coreSampleFraction": 0.5, "distance": "euclidean"}),
        ("coreset", {"k": 4, "m": 150}), ("coreset", {"k": 4, "m": 150, "inner": "medoids", "distance": "cosine"}),
    ],
)
def test_runs_meet_the_schema(spark, name, params):
    got = run(RunConfig.of(BASE | {"algorithm": {"name": name, "params": params}, "evaluation": {"metrics": ALL, "sampleSize": 200}}), spark)
    assert got["status"] == "ok", got.get("errorMessage")
    assert R.problems(json.loads(R.serialized(got))) == []
    assert got["nRows"] == 600 and got["nFeatures"] == 3 and set(got["phaseDurationsMs"]) == {"load", "fit", "eval"}


@pytest.mark.parametrize(
    "doc,message",
    [
        ({"algorithm": {"name": "x", "params": {}}}, "Unknown algorithm: 'x'. Known: bisectingkmeans, clara"), ({"algorithm": {"name": "kmeans", "params": {}}}, "Missing required parameter: 'k'"),
        ({"algorithm": {"name": "clara", "params": {"k": 2}}}, "Missing required 'distance' parameter"), ({"algorithm": {"name": "kmeans", "params": {"k": 2, "refine": "x"}}}, "Unknown refine mode"),
        ({"algorithm": {"name": "coreset", "params": {"k": 2, "m": 9, "inner": "x"}}}, "Unknown inner algorithm"), ({"algorithm": {"name": "dbscanpp", "params": {"eps": 1, "minPts": 1, "coreSampleFraction": 1, "assign": "x"}}}, "Unknown assign mode"),
        ({"algorithm": {"name": "kmeans", "params": {"k": 2}}, "dataset": {"type": "x", "params": {}}}, "Unknown data source"),
    ],
)
def test_failures_are_results(spark, doc, message):
    got = run(RunConfig.of(BASE | doc), spark)
    assert got["status"] == "failed" and message in got["errorMessage"] and got["nRows"] == -1
    assert R.problems(got) == []


def test_result_file(tmp_path):
    path = R.write({"runId": "a", "status": "ok", "x": None}, str(tmp_path / "o"))
    assert os.listdir(tmp_path / "o") == ["a.json"] and open(path).read() == '{"runId":"a","status":"ok"}'
    with pytest.raises(ValueError):
        R.serialized({"silhouette": float("nan")})
    assert "unknown: y" in R.problems({"y": 1}) and "missing: runId" in R.problems({})


def test_cli(spark, tmp_path, capsys):
    assert main(["--help"]) == 0 and main([]) == 64 and main(["--x"]) == 64
    config = tmp_path / "run.json"
    config.write_text(json.dumps(BASE | {"algorithm": {"name": "nope"}, "outputDir": str(tmp_path / "out")}))
    assert main(["--config", str(config)]) == 2
    assert json.load(open(tmp_path / "out/t.json"))["status"] == "failed"


def test_params():
    p = Params({"a": 1, "b": 2.5, "c": "x", "d": None, "e": True})
    assert (p.int("a"), p.double("a"), p.double("b"), p.string("c"), p.int_opt("d", 7)) == (1, 1.0, 2.5, "x", 7)
    for bad in ("b", "c", "e"):
        with pytest.raises(ValueError):
            p.int(bad)
    assert p.echo() == {"a": "1", "b": "2.5", "c": "x", "d": "null", "e": "true"}
    assert DISTANCES.get("EUCLIDEAN").name == "euclidean" and ALGORITHMS.get("CLARA")


def test_counters_are_differences_and_peaks_are_not():
    base = M.Snapshot({"a": M.Reading(100), "b": M.Reading(80)})
    now = M.Snapshot({"a": M.Reading(250, peak_heap=5), "b": M.Reading(180, peak_heap=7), "late": M.Reading(30)})
    assert now.since(base)["cpu_ns"] == 280
    assert M.Snapshot({"a": M.Reading(40)}).since(base)["cpu_ns"] == 0
    assert now.peaks()["peak_heap"] == 7 and now.peaks()["total_heap"] == 12
    mid = M.Snapshot({"a": M.Reading(180), "b": M.Reading(90)})
    assert mid.since(base)["cpu_ns"] + now.since(mid)["cpu_ns"] == now.since(base)["cpu_ns"]
    assert M.average_cores(1e9, 0) is None and M.average_cores(2e9, 1000) == 2.0 and M.core_hours(3.6e12) == 1 and M.gb_hours(1024**3 * 3600) == 1


def test_stream_labels(spark, tmp_path):
    spark.range(50).select(F.array(F.col("id").cast("double")).alias("features")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("features array<double>").parquet(str(tmp_path / "in"))
    labelled_stream(PrototypeModel([[0.0], [49.0]], EUCLIDEAN), stream, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("prediction").count().collect()
    assert {r.prediction: r["count"] for r in got} == {0: 25, 1: 25}


def test_executor_readings_are_cpu_time_and_peaks(spark):
    """The status store of a local session has the driver only; as an executor it shows what a reading holds."""
    from lodestrata.plans.metrics import executors

    assert executors(spark).workers == {}
    before = executors(spark, driver=True).workers["driver"]
    spark.range(20_000_000).selectExpr("sum(hash(id))").collect()
    after = executors(spark, driver=True).workers["driver"]
    assert after.cpu_ns - before.cpu_ns > 1e7 and after.peak_heap > 1 << 20 and after.peak_direct >= 0
