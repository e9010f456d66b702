import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import distance as D
from lodestrata.functions.geometry import SPHERICAL_GEOMETRY, l2_normalized, normalize
from lodestrata.functions.uniform import content_uniform, keyed_uniform
from lodestrata.functions.weights import feature_column, sanitize, total_mass, with_weights
from lodestrata.sources import ParquetSource, SyntheticSource

METRICS = [D.EUCLIDEAN, D.MANHATTAN, D.COSINE, D.UNIT_SPHERE]


@pytest.mark.parametrize("metric", METRICS, ids=lambda m: m.name)
def test_column_and_block_agree(spark, metric):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(20, 7)), np.zeros((1, 7))])
    df = spark.createDataFrame([(i, j, x[i].tolist(), x[j].tolist()) for i in range(21) for j in range(21)], "i int, j int, a array<double>, b array<double>")
    rows = df.select("i", "j", metric.column(F.col("a"), F.col("b")).alias("d"), metric.within(F.col("a"), F.col("b"), 1.0).alias("near"), metric.up_to(F.col("a"), F.col("b"), 1.0).alias("up")).collect()
    block, near = metric.block(x, x), metric.block_within(x, x, 1.0)
    for r in rows:
        assert math.isclose(r.d, block[r.i, r.j], abs_tol=1e-12)
        assert r.near == near[r.i, r.j]
        assert r.up == (r.d if r.near else float("inf"))


def test_radius_boundary(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>")
    for metric, edge in ((D.EUCLIDEAN, 5.0), (D.MANHATTAN, 7.0)):
        a, b = df.select(metric.within(F.col("a"), F.col("b"), edge), metric.within(F.col("a"), F.col("b"), edge - 1e-6)).first()
        assert a and not b


def test_cosine_of_zero_vectors():
    assert D.COSINE.block(np.zeros((1, 2)), np.zeros((1, 2)))[0, 0] == 1.0


def test_nan_is_outside_and_never_nearest():
    x = np.array([[np.nan, 0.0]])
    assert not D.EUCLIDEAN.block_within(x, np.zeros((1, 2)), 10)[0, 0]
    assert D.nearest(D.EUCLIDEAN, np.zeros((1, 2)), np.array([[np.nan, 0], [5.0, 0]]))[0][0] == 1


def test_ties_go_to_the_lowest_index():
    assert D.nearest(D.EUCLIDEAN, np.array([[0.0]]), np.array([[1.0], [-1.0]]))[0][0] == 0


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r[0] for r in df.select(l2_normalized(F.col("v"))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]
    assert np.allclose(normalize(np.array([[3.0, 4.0], [0, 0]])), got)
    assert SPHERICAL_GEOMETRY.prepare(df.withColumnRenamed("v", "features")).first()[0] == [0.6, 0.8]


def test_weights(spark):
    rows = [([1.0], w) for w in (2.0, None, float("nan"), -5.0, float("inf"), 0.0)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "features array<double>, weight double")
    assert total_mass(df) == 3.0
    assert sorted(r.weight for r in with_weights(df).collect()) == [0.0] * 5 + [2.0]
    assert total_mass(df.limit(0)) == 0.0
    assert sanitize(None) == sanitize(float("nan")) == sanitize(-1) == 0.0


def test_feature_types(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), [1, 2], "x")], ["v", "a", "s"])
    assert df.select(feature_column(df, "v")).first()[0] == df.select(feature_column(df, "a")).first()[0] == [1.0, 2.0]
    with pytest.raises(ValueError, match="unsupported feature-column type"):
        feature_column(df, "s")


def test_uniforms_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("features", F.array(F.col("id").cast("double")))
    for u in (keyed_uniform(F.col("id"), 42), content_uniform(F.col("features"), seed=42)):
        a = {r.id: r.u for r in df.repartition(1).select("id", u.alias("u")).collect()}
        b = {r.id: r.u for r in df.repartition(13).select("id", u.alias("u")).collect()}
        assert a == b and 0 <= min(a.values()) and max(a.values()) < 1 and abs(np.mean(list(a.values())) - 0.5) < 0.05
    assert keyed_uniform_of_17(spark) == 0.3597033603342046


def keyed_uniform_of_17(spark):
    return spark.range(17, 18).select(keyed_uniform(F.col("id"), 42)).first()[0]


def test_parquet_source(spark, tmp_path):
    spark.range(100).select(F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("emb"), (F.col("id") + 1).cast("string").alias("w")).write.parquet(str(tmp_path / "t"))
    df = ParquetSource(str(tmp_path / "t"), "emb", 3, "w").load(spark)
    assert df.columns == ["features", "weight"] and df.rdd.getNumPartitions() == 3
    assert dict(df.dtypes)["features"] == "array<double>" and df.agg(F.sum("weight")).first()[0] == 5050
    assert 0 < ParquetSource(str(tmp_path / "t"), "emb", sample_fraction=0.3).load(spark).count() < 70
    with pytest.raises(ValueError, match="unsupported"):
        ParquetSource(str(tmp_path / "t"), "w").load(spark)


def test_synthetic_source(spark):
    df = SyntheticSource(5000, 3, 7).load(spark)
    x = np.array([r[0] for r in df.collect()])
    assert x.shape == (5000, 3) and df.rdd.getNumPartitions() == 3
    assert 0.25 < (np.abs(x - 200).max(axis=1) < 6).mean() < 0.35
    assert df.exceptAll(SyntheticSource(5000, 3, 7).load(spark)).count() == 0
