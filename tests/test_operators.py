import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.columns import PREDICTION
from lodestrata.functions.distance import COSINE, EUCLIDEAN, MANHATTAN
from lodestrata.functions.geometry import EUCLIDEAN_GEOMETRY, SPHERICAL_GEOMETRY
from lodestrata.functions.weights import with_weights
from lodestrata.operators import evaluate as E
from lodestrata.operators.bisecting import BisectingKMeans, split_cost
from lodestrata.operators.coreset import Coreset, LocalLloyd, LocalMedoids
from lodestrata.operators.dbscan import DBSCANpp, UnionFind, core_components, densities, epsilon_components
from lodestrata.operators.kmeans import BreathingKMeans, KMeans, breathing_stats, lloyd
from lodestrata.operators.medoids import CLARA, PAMAE, medoid_costs, refine
from lodestrata.operators.models import BisectingKMeansModel, CoreLabelModel, LabelColumnModel, Node, PrototypeModel
from lodestrata.operators.pam import Cache, FasterPAM, FastPAM, deltas, distance_matrix, solver
from lodestrata.operators.sampling import lightweight_coreset, multi_sample, silhouette_sample, uniform_candidates, weighted_top


def frame(spark, x, w=None, parts=3):
    rows = [(np.atleast_1d(v).astype(float).tolist(), None if w is None else float(w[i])) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "features array<double>, weight double").repartition(parts)
    return df.drop("weight") if w is None else df


def labelled(spark, x, labels, w=None):
    rows = [(np.atleast_1d(v).astype(float).tolist(), l, None if w is None or w[i] is None else float(w[i])) for i, (v, l) in enumerate(zip(x, labels, strict=True))]
    df = spark.createDataFrame(rows, "features array<double>, __label int, weight double")
    return df.drop("weight") if w is None else df


def blobs(centres, n, sigma, seed=0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, sigma, (n, len(c))) for c in centres])


@pytest.fixture(scope="module")
def three(spark):
    x = blobs([(0, 0), (40, 0), (0, 40)], 120, 1.5)
    return x, frame(spark, x).cache()


def cost_of(x, prototypes, metric=EUCLIDEAN):
    return float((metric.block(x, np.array(prototypes)).min(axis=1) ** 2).sum())


# --- k-means


def test_kmeans_finds_blobs_and_keeps_partitions_apart(spark, three):
    x, df = three
    model = KMeans(3, 30, 1e-4, 3).fit(df, x[[0, 150, 300]])
    assert sorted(np.round(model.centroids).astype(int).tolist()) == [[0, 0], [0, 40], [40, 0]]
    a = lloyd(with_weights(df.repartition(1)), x[:3], 4, 0.0, EUCLIDEAN_GEOMETRY)[0]
    b = lloyd(with_weights(df.repartition(7)), x[:3], 4, 0.0, EUCLIDEAN_GEOMETRY)[0]
    assert np.allclose(a, b)
    assert model.iterations_run <= 30 and df.storageLevel.useMemory


def test_weighted_mean(spark):
    assert KMeans(1).fit(frame(spark, [[0], [10]], [1, 9])).centroids.tolist() == [[9.0]]


def test_weighting_is_duplication(spark):
    x = np.array([[0, 0], [0.4, 0], [10, 0], [10.4, 0], [30, 0], [30.4, 0]])
    w = [1, 1, 5, 5, 2, 2]
    weighted, plain = frame(spark, x, w), frame(spark, np.repeat(x, w, axis=0))
    init = x[[0, 2, 4]]
    assert np.allclose(KMeans(3).fit(weighted, init).centroids, KMeans(3).fit(plain, init).centroids)
    a, b = BisectingKMeans(3).fit(weighted), BisectingKMeans(3).fit(plain)
    assert np.allclose(sorted(a.cluster_centroids.tolist()), sorted(b.cluster_centroids.tolist()))
    for s in (FastPAM(3, metric=EUCLIDEAN), FasterPAM(3, metric=EUCLIDEAN)):
        c = s.fit_local(x, np.array(w, float)).cost
        assert np.isclose(c, s.fit_local(np.repeat(x, w, axis=0), np.ones(sum(w))).cost)
    cores = lambda df: sorted({tuple(c) for c in DBSCANpp(1.0, 4, 1.0, metric=EUCLIDEAN).fit(df).core_points.tolist()})
    assert cores(weighted) == cores(plain)
    assert [c[0] for c in cores(weighted)] == [10.0, 10.4, 30.0, 30.4]


def test_empty_cell_keeps_its_centre(spark):
    model = KMeans(2, 5).fit(frame(spark, [[0], [1]]), [[0.5], [100.0]])
    assert model.centroids.tolist() == [[0.5], [100.0]]


def test_too_few_rows(spark):
    with pytest.raises(ValueError, match="too small"):
        KMeans(5).fit(frame(spark, [[0], [1]]))
    with pytest.raises(ValueError, match="too small"):
        BisectingKMeans(5).fit(frame(spark, [[0], [1]]))


def test_spherical_centres_have_length_one(spark, three):
    model = KMeans(3, 10, geometry=SPHERICAL_GEOMETRY).fit(three[1])
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1) and model.metric is COSINE


def test_breathing_is_never_worse(spark):
    x = blobs([(0, 0), (30, 0), (0, 30), (30, 30), (60, 60)], 40, 1.5)
    df = frame(spark, x).cache()
    init = x[[0, 1, 2, 3, 4]]
    plain, breathing = KMeans(5).fit(df, init), BreathingKMeans(5, 2).fit(df, init)
    assert cost_of(x, breathing.centroids) <= cost_of(x, plain.centroids)
    assert len(breathing.centroids) == 5 and breathing.iterations_run > plain.iterations_run
    one = BreathingKMeans(1, 1, max_cycles=2).fit(frame(spark, [[0], [10]], [1, 9]))
    assert one.centroids.tolist() == [[9.0]]
    assert (breathing_stats(with_weights(df), x[:1], EUCLIDEAN_GEOMETRY)[:, 2] == 0).all()


def test_bisecting(spark, three):
    x, df = three
    model = BisectingKMeans(3, seed=1).fit(df)
    assert model.num_clusters == 3
    assert np.allclose(sorted(np.round(model.cluster_centroids).tolist()), [[0, 0], [0, 40], [40, 0]])
    with pytest.raises(ValueError, match="Unknown leaf selection: 'x'. Known: cost, size"):
        BisectingKMeans(2, select="x")
    one = BisectingKMeans(2, seed=11).fit(df).cluster_centroids
    five = BisectingKMeans(2, seed=11, trials=3).fit(df).cluster_centroids
    points = with_weights(df)
    assert split_cost(points, five, EUCLIDEAN_GEOMETRY) <= split_cost(points, one, EUCLIDEAN_GEOMETRY) + 1e-9
    same = BisectingKMeans(3).fit(frame(spark, [[1.0]] * 5))
    assert same.num_clusters == 1


def test_expressions_agree_with_arrow(spark, three):
    x, df = three
    flat = PrototypeModel(x[[0, 5, 200]], MANHATTAN)
    tree = BisectingKMeansModel(Node(x[0], Node(x[0]), Node(x[9], Node(x[150]), Node(x[300]))), EUCLIDEAN)
    for m in (flat, tree):
        assert m.assign(df).where(F.col(PREDICTION) != m.expression(F.col("features"))).count() == 0


# --- k-medoids


@pytest.mark.parametrize("weighted", [False, True])
def test_swap_deltas_are_cost_differences(weighted):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    w = 1.0 + np.arange(80) % 7 if weighted else np.ones(80)
    d = distance_matrix(x, EUCLIDEAN)
    for k in (1, 4):
        medoids = list(range(k))
        now = (w * d[medoids].min(axis=0)).sum()
        for h in range(k, 80):
            change = deltas(d, w, Cache.of(d, medoids), k, h)
            for s in range(k):
                other = [*medoids[:s], h, *medoids[s + 1 :]]
                assert np.isclose(change[s], (w * d[other].min(axis=0)).sum() - now)


def test_solvers_agree_on_blobs():
    x = blobs([(0, 0), (50, 0), (0, 50)], 60, 1.0)
    a, b = (solver(n, 3, 100, EUCLIDEAN, 1).fit_local(x, np.ones(180)) for n in ("fastpam", "FasterPAM"))
    assert np.isclose(a.cost, b.cost)
    with pytest.raises(ValueError, match="Unknown inner k-medoids solver"):
        solver("x", 3, 1, EUCLIDEAN, 1)
    with pytest.raises(ValueError, match="too large"):
        distance_matrix(np.zeros((50_000, 1)), EUCLIDEAN)


def test_clara_and_pamae(spark):
    x = blobs([(0, 0), (30, 0), (0, 30), (30, 30)], 100, 2.0)
    df = frame(spark, x).cache()
    a = CLARA(4, 3, 100, metric=EUCLIDEAN).fit(df)
    b = PAMAE(4, 3, 100, pool_size=200, metric=EUCLIDEAN).fit(df)
    costs = medoid_costs(with_weights(df), [a.medoids, b.medoids], EUCLIDEAN)
    assert costs[1] <= costs[0] + 1e-9 and len(np.unique(np.round(a.medoids / 30), axis=0)) == 4
    _, cost, ran = refine(with_weights(df), a.medoids, x[:50], EUCLIDEAN, 3)
    assert ran >= 1 and cost > 0
    with pytest.raises(ValueError):
        PAMAE(4, refine_iters=0, metric=EUCLIDEAN)
    with pytest.raises(ValueError, match="at least one medoid set"):
        medoid_costs(df, [], EUCLIDEAN)


def test_samples_span_ordered_input(spark):
    df = with_weights(spark.range(0, 20_000, 1, 8).select(F.array(F.col("id").cast("double"), F.lit(0.0)).alias("features")))
    got = multi_sample(df, 3, 500, 20_000, 1).groupBy("sample_id").agg(F.count("*").alias("n"), F.min(F.col("features")[0]).alias("a"), F.max(F.col("features")[0]).alias("b")).collect()
    assert len(got) == 3 and all(500 <= r.n <= 800 and r.a < 1000 and r.b > 19_000 for r in got)
    x = uniform_candidates(df, 400, 20_000, 1)
    assert len(x) == 400 and (np.diff(x[:, 0]) > 0).all() and x[0, 0] < 1500 and x[-1, 0] > 18_500


def test_weighted_top_skips_rows_without_weight(spark):
    df = with_weights(frame(spark, np.arange(50.0), [0.0] * 40 + [1.0] * 10))
    assert weighted_top(df, 10, 1).min() >= 40
    with pytest.raises(ValueError):
        weighted_top(df, 11, 1)


# --- density


def grids():
    g = np.array([(0.3 * i, 0.3 * j) for i in range(5) for j in range(5)])
    return np.vstack([g, g + 10, [[50, 50]]])


def test_exact_dbscan_equals_the_textbook(spark):
    x = np.vstack([grids(), np.random.default_rng(1).uniform(-1, 12, (60, 2))])
    eps, least = 0.5, 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= least
    uf = UnionFind(len(x))
    for i in np.flatnonzero(core):
        for j in np.flatnonzero(core & d[i]):
            uf.union(i, j)
    model = DBSCANpp(eps, least, 1.0, metric=EUCLIDEAN).fit(frame(spark, x))
    got = {tuple(r.features): r.prediction for r in model.assign(frame(spark, x)).collect()}
    comps = {}
    for i in np.flatnonzero(core):
        comps.setdefault(uf.find(i), set()).add(got[tuple(x[i])])
    assert all(len(c) == 1 for c in comps.values()) and len({min(c) for c in comps.values()}) == len(comps)
    for i in np.flatnonzero(~core):
        assert (got[tuple(x[i])] == -1) == (not (d[i] & core).any())


def test_two_grids_and_none(spark):
    df = frame(spark, grids())
    model = DBSCANpp(0.5, 4, 1.0, metric=EUCLIDEAN).fit(df)
    labels = [r.prediction for r in model.assign(df).collect()]
    assert model.number_of_clusters == 2 and labels.count(-1) == 1 and len(labels) == 51
    near = DBSCANpp(0.5, 4, 1.0, require_within_eps=False, metric=EUCLIDEAN).fit(df)
    assert -1 not in [r.prediction for r in near.assign(df).collect()]
    none = DBSCANpp(0.01, 10, 1.0, require_within_eps=False, metric=EUCLIDEAN).fit(df)
    assert {r.prediction for r in none.assign(df).collect()} == {-1}
    assert DBSCANpp(0.5, 4, 0.6, metric=EUCLIDEAN).fit(df).reduction_size <= 31
    for bad in (0.0, 1.5):
        with pytest.raises(ValueError):
            DBSCANpp(0.5, 4, bad, metric=EUCLIDEAN)
    with pytest.raises(ValueError, match="Unknown candidate sampling"):
        DBSCANpp(0.5, 4, 1.0, "x", metric=EUCLIDEAN)


def test_chunks_do_not_matter(spark):
    x = np.random.default_rng(2).normal(size=(120, 3))
    df = with_weights(frame(spark, x))
    assert np.allclose(densities(df, x, 1.0, EUCLIDEAN, chunk=17), densities(df, x, 1.0, EUCLIDEAN))
    a, b = (CoreLabelModel(x[:40], np.arange(40) % 4, 1.0, EUCLIDEAN, chunk=c).assign(df).select("features", PREDICTION) for c in (7, 50))
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("metric,eps", [(EUCLIDEAN, 5.0), (MANHATTAN, 7.0), (COSINE, 0.4)])
def test_strips_lose_no_pair(spark, metric, eps):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.integers(-9, 9, (700, 2)).astype(float), [[0, 0], [3, 4], [np.nan, 1], [1e9, 0], [1e9, 5]]])
    w = rng.random(len(x)) + 0.5
    got = densities(with_weights(frame(spark, x, w)), x, eps, metric, block=16)
    with np.errstate(invalid="ignore"):
        want = (w[:, None] * (metric.block(x, x) <= eps)).sum(axis=0)
    near = metric.block_within(x, x, eps)
    assert np.allclose(got, (w[:, None] * near).sum(axis=0)) and np.allclose(got[:700], want[:700])


def test_components_match_a_search(spark):
    x = np.array([(0.001 * (i % 7), 0.001 * (i // 7)) for i in range(2000)])
    assert set(epsilon_components(spark, x, 1.5, EUCLIDEAN, block=256).tolist()) == {0}
    x = np.random.default_rng(4).uniform(0, 10, (300, 2))
    got = epsilon_components(spark, x, 0.5, EUCLIDEAN, block=64)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.5
    seen, label = {}, 0
    for i in range(300):
        if i in seen:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in seen:
                seen[j] = label
                todo += np.flatnonzero(d[j]).tolist()
        label += 1
    assert got.tolist() == [seen[i] for i in range(300)]
    assert len(epsilon_components(spark, np.empty((0, 2)), 1.0, EUCLIDEAN)) == 0


@pytest.mark.parametrize("pivots,eps", [(1, 0.5), (8, 0.9), (64, 0.5), (2048, 0.5), (40, 5.0), (16, 0.01)])
def test_core_components_equal_those_on_the_driver(spark, pivots, eps):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.uniform(0, 10, (400, 2)), rng.normal(size=(150, 2)) * 0.1 + 20, [[np.nan, 1], [30, 30], [30, 30]]])
    w = rng.integers(0, 4, len(x)).astype(float)
    rows = [(int(i), x[i].tolist(), float(w[i])) for i in rng.permutation(len(x))]
    df = spark.createDataFrame(rows, "id long, features array<double>, weight double").repartition(5)
    core = densities(df.select("features", "weight"), x, eps, EUCLIDEAN) >= 4
    want = dict(zip(np.flatnonzero(core).tolist(), epsilon_components(spark, x[core], eps, EUCLIDEAN, block=32).tolist(), strict=True))
    got = {r.id: r.cluster for r in core_components(df, "id", eps, 4.0, EUCLIDEAN, pivots, chunk=90).collect()}
    assert got == want
    assert core_components(df.limit(0), "id", eps, 4.0, EUCLIDEAN).collect() == []


def test_components_send_few_edges_to_the_driver(spark, monkeypatch):
    sent, real = [], type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda df: sent.append(real(df)) or sent[-1])
    x = np.random.default_rng(3).normal(size=(3000, 2))
    assert set(epsilon_components(spark, x, 2.5, EUCLIDEAN, block=64).tolist()) == {0}
    assert sum(t.num_rows for t in sent) <= 17 * len(x)
    df = spark.createDataFrame([(i, r.tolist(), 1.0) for i, r in enumerate(x)], "id long, features array<double>, weight double")
    sent.clear()
    assert core_components(df, "id", 2.5, 3.0, EUCLIDEAN, 64).select("cluster").distinct().count() == 1
    assert sum(t.num_rows for t in sent) < len(x)


def test_union_find():
    u = UnionFind(7)
    assert [u.union(*p) for p in ((6, 3), (5, 1), (4, 1), (4, 5))] == [True, True, True, False]
    assert u.labels().tolist() == [0, 1, 2, 3, 1, 1, 3]


# --- coreset


def test_coreset_keeps_mass_and_cost(spark):
    x = blobs([(0, 0), (40, 0), (0, 40)], 400, 1.5)
    df = with_weights(frame(spark, x))
    draws = [lightweight_coreset(df, 300, EUCLIDEAN, s) for s in range(6)]
    assert abs(np.mean([w.sum() for _, w, _, _ in draws]) / 1200 - 1) < 0.08
    model = Coreset(3, 300, LocalLloyd(3, seed=5)).fit(df)
    assert model.requested_size == 300 and model.reduction_size > 100 and len(model.prototypes) == 3
    assert len(Coreset(3, 300, LocalMedoids(3, EUCLIDEAN)).fit(df).prototypes) == 3
    with pytest.raises(ValueError):
        Coreset(3, 2, LocalLloyd(3))


def test_outlier_is_always_drawn(spark):
    x = np.vstack([np.random.default_rng(0).normal(size=(2000, 2)), [[500, 500]]])
    df = with_weights(frame(spark, x)).cache()
    assert all((lightweight_coreset(df, 50, EUCLIDEAN, s)[0].max(axis=1) > 400).any() for s in range(4))


def test_local_lloyd_equals_the_distributed_one(spark, three):
    x, df = three
    a = LocalLloyd(3, 6, 0.0).iterate(x, np.ones(len(x)), x[[0, 1, 2]])[0]
    assert np.allclose(a, KMeans(3, 6, 0.0).fit(df, x[[0, 1, 2]]).centroids)


# --- evaluation


def scores(spark, x, labels, w=None, metric=EUCLIDEAN):
    rows = E.labelled(LabelColumnModel(), labelled(spark, x, labels, w))
    found = E.moments(LabelColumnModel(), rows, metric)
    return E.silhouette(rows, metric, weighted=w is not None), E.davies_bouldin(found, metric), E.calinski_harabasz(found, metric)


def test_two_pairs(spark):
    s, db, ch = scores(spark, [0, 2, 10, 12], [0, 0, 1, 1])
    assert np.isclose(s.score, 79 / 99) and np.isclose(db, 0.2) and np.isclose(ch, 50)
    s, db, ch = scores(spark, [0, 2, 10, 12, 500, -500], [0, 0, 1, 1, -1, -1])
    assert np.isclose(s.score, 79 / 99) and np.isclose(db, 0.2) and np.isclose(ch, 50)


def test_silhouette_fixtures(spark):
    assert np.isclose(scores(spark, [0, 0, 2, 10], [0, 0, 0, 1])[0].score, 0.6375)
    assert np.isclose(scores(spark, [0, 2, 100], [0, 0, 1])[0].score, (0.98 + 96 / 98) / 3)
    assert scores(spark, [0, 2, 9], [0, 0, 0]) == (E.Silhouette(0.0, 0, 1, 3), 0.0, 0.0)
    assert scores(spark, [[0, 0], [0, 0], [1, 0], [0, 1]], [0, 0, 1, 1], metric=COSINE)[0].score == 0.0


def test_weighted_silhouette_is_duplication(spark):
    a = scores(spark, [0, 2, 10, 12], [0, 0, 1, 1], [2, 1, 1, 2.0])
    b = scores(spark, [0, 0, 2, 10, 12, 12], [0, 0, 0, 1, 1, 1])
    assert np.isclose(a[0].score, b[0].score) and np.isclose(a[1], b[1]) and np.isclose(a[2], b[2])
    half = scores(spark, [0, 1, 100, 101], [0, 0, 1, 1], [0.6] * 4)[0].score
    assert np.isclose(half, scores(spark, [0, 1, 100, 101], [0, 0, 1, 1])[0].score)


@pytest.mark.parametrize("bad", [(float("nan"), 1.0), (float("inf"), 1.0), (5.0, None), (5.0, -5.0), (5.0, float("nan"))])
def test_corrupt_rows_cost_only_themselves(spark, bad):
    s = scores(spark, [0, 2, 10, 12, bad[0]], [0, 0, 1, 1, 0], [1.0, 1.0, 1.0, 1.0, bad[1]])[0]
    assert np.isclose(s.score, 79 / 99) and s.scored == 4


def test_underdrawn_cluster_is_unscored(spark):
    rows = E.labelled(LabelColumnModel(), labelled(spark, [0, 2, 10, 12, 1000], [0, 0, 1, 1, 2]))
    s = E.silhouette(rows, EUCLIDEAN, masses={0: 2.0, 1: 2.0, 2: 1000.0})
    assert np.isclose(s.score, 79 / 99) and (s.scored, s.unscored, s.clusters) == (4, 1, 3)


def test_coincident_centres(spark):
    assert scores(spark, [0, 2, 0, 2], [0, 0, 1, 1])[1] == 0.0


def test_subsample_counts_copies(spark):
    rows = with_weights(frame(spark, np.arange(2000.0), np.full(2000, 3.0)), *[]).withColumn(PREDICTION, F.lit(0))
    got = silhouette_sample(rows, 600, 1, 6000.0, True)
    assert abs(got.count() - 600) < 80 and got.agg(F.max("weight")).first()[0] == 1.0
    assert silhouette_sample(rows, 10_000, 1, 6000.0, True) is rows


def test_evaluate(spark, three):
    x, df = three
    model = KMeans(3).fit(df, x[[0, 150, 300]])
    got = E.evaluate(model, df, EUCLIDEAN, E.Spec(E.METRICS)).values
    assert got["nClusters"] == 3 and sum(got["clusterSizes"].values()) == 360 and got["noiseFraction"] == 0.0
    assert got["silhouette"] > 0.8 and got["daviesBouldin"] < 0.3 and got["calinskiHarabasz"] > 100
    with pytest.raises(ValueError, match="Unknown evaluation metric"):
        E.evaluate(model, df, EUCLIDEAN, E.Spec(("x",)))
