"""The registered queries of the clustering operators, each with the same result in SQL where SQL can express it.

Prototypes, cores and candidates are drawn by a hash of the row's id, as the sampling operators do, so that every
engine draws the same. Sums are rounded, for their order differs between engines.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import FEATURES, NOISE, PREDICTION, WEIGHT
from .functions.distance import COSINE, EUCLIDEAN, MANHATTAN, UNIT_SPHERE, Metric
from .functions.geometry import EUCLIDEAN_GEOMETRY, SPHERICAL_GEOMETRY, l2_normalized
from .functions.uniform import keyed_uniform
from .functions.weights import sanitized, with_weights
from .operators import evaluate as E
from .operators.bisecting import BisectingKMeans, leaf_stats, split_cost
from .operators.coreset import Coreset, LocalLloyd, LocalMedoids
from .operators.dbscan import CoreLabelModel, DBSCANpp, candidate_count, core_components, densities, epsilon_components
from .operators.kmeans import BreathingKMeans, KMeans, breathing_stats, lloyd, mean_of
from .operators.medoids import CLARA, PAMAE, candidate_costs, medoid_costs
from .operators.models import BisectingKMeansModel, LabelColumnModel, Node, PrototypeModel, collected, literal, nearest_ordinals
from .operators.pam import Cache, FasterPAM, FastPAM, build, deltas, distance_matrix
from .operators.sampling import ares_key, candidate_rows, chance_samples, coreset_moments, coreset_rows, silhouette_sample, weighted_top_rows
from .sources import ParquetSource, SyntheticSource

SEED = 42
K = 6
EPS, MIN_PTS = 1.2, 4.0

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- tables -----------------------------------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[vec_id, label, features, weight]; the weight is 1 to 5 by id."""
    e = _read(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias(FEATURES), (F.col("vec_id") % 5 + 1).cast("double").alias(WEIGHT))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[features, weight] of all line items: scaled price, discount and tax, weighted by quantity."""
    t = _read(spark, sf_dir, "lineitem")
    return t.select(F.array(F.col("l_extendedprice") / 100000.0, F.col("l_discount"), F.col("l_tax")).alias(FEATURES), F.col("l_quantity").alias(WEIGHT))


def drawn(points: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """k rows by the hash of their ids, in the order of the hash: the prototypes of a query."""
    rows = points.select(FEATURES, keyed_uniform(F.col("vec_id"), seed).alias("u"), "vec_id").orderBy("u", "vec_id").limit(k).collect()
    return np.array([r[FEATURES] for r in rows])


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS f, (vec_id % 5 + 1)::DOUBLE AS w, ('0x' || substr(md5(vec_id::VARCHAR || '|42'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM embeddings)"
_P = f"p AS (SELECT row_number() OVER (ORDER BY u, vec_id)::INT - 1 AS i, f AS c FROM v QUALIFY i < {K})"
_SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_ABS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"


def _sq(a: str, b: str) -> str:
    return _SQ.format(a=a, b=b)


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


_NEAR = f"near AS (SELECT vec_id, label, f, w, i, d FROM (SELECT v.*, p.i, {_sq('v.f', 'p.c')} AS d FROM v, p) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1)"

# --- sources ----------------------------------------------------------------------------------------------------


@query("SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS features FROM embeddings")
def scan_embeddings(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", FEATURES)


@query("SELECT count(*)::BIGINT AS n, round(sum(array_sum), 4) AS total FROM (SELECT list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS array_sum FROM embeddings)")
def scan_source(spark, sf_dir):
    source = ParquetSource(f"{sf_dir}/embeddings.parquet", "embedding", num_partitions=4, weight_column="label")
    total = F.aggregate(FEATURES, F.lit(0.0), lambda s, x: s + x)
    return source.load(spark).agg(F.count("*").alias("n"), F.round(F.sum(total), 4).alias("total"))


@query("SELECT list_transform(embedding, lambda x: x::DOUBLE) AS features, label::DOUBLE AS weight FROM embeddings")
def scan_weighted(spark, sf_dir):
    return ParquetSource(f"{sf_dir}/embeddings.parquet", "embedding", weight_column="label").load(spark)


@query(f"WITH {_V} SELECT f AS features FROM v WHERE u < 0.25::DOUBLE")
def scan_sample(spark, sf_dir):
    return ParquetSource(f"{sf_dir}/embeddings.parquet", "embedding", sample_fraction=0.25, seed=SEED, sample_key="vec_id").load(spark)


@query()
def synthetic_mixture(spark, sf_dir):
    """Rows of the generator, counted by the unit cube of hundreds they fall in."""
    df = SyntheticSource(20_000, 8, SEED).load(spark)
    return df.groupBy(F.transform(FEATURES, lambda x: F.floor(x / 100)).alias("cube")).count()


# --- projections ------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0.0::DOUBLE END AS weight FROM supplier")
def weights_sanitize(spark, sf_dir):
    return _read(spark, sf_dir, "supplier").select("s_suppkey", sanitized(F.col("s_acctbal")).alias(WEIGHT))


@query("SELECT round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END), 2)::DOUBLE AS mass FROM customer")
def total_mass(spark, sf_dir):
    return _read(spark, sf_dir, "customer").agg(F.round(F.sum(sanitized(F.col("c_acctbal"))), 2).alias("mass"))


@query("WITH t AS (SELECT p_partkey, [p_size::DOUBLE, p_retailprice::DOUBLE] AS f FROM part) SELECT p_partkey, round(f[1] / sqrt(f[1] * f[1] + f[2] * f[2]), 9) AS x, round(f[2] / sqrt(f[1] * f[1] + f[2] * f[2]), 9) AS y FROM t")
def l2_normalize(spark, sf_dir):
    t = _read(spark, sf_dir, "part").select("p_partkey", l2_normalized(F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"))).alias("f"))
    return t.select("p_partkey", F.round(F.col("f")[0], 9).alias("x"), F.round(F.col("f")[1], 9).alias("y"))


@query(f"WITH {_V} SELECT vec_id, u FROM v")
def keyed_uniforms(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", keyed_uniform(F.col("vec_id"), SEED).alias("u"))


@query("SELECT vec_id FROM embeddings WHERE label <> 3")
def noise_filter(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn(PREDICTION, F.when(F.col("label") == 3, NOISE).otherwise(F.col("label")))
    return E.without_noise(v).select("vec_id")


def _distances(spark, sf_dir, metric: Metric) -> DataFrame:
    v = vectors(spark, sf_dir)
    c = drawn(v, K)
    each = v.select("vec_id", F.posexplode(F.array(*(metric.column(F.col(FEATURES), literal(p)) for p in c))).alias("i", "d"))
    return _rounded(each, 9, "d")


@query(f"WITH {_V}, {_P} SELECT vec_id, i, round(sqrt({_sq('v.f', 'p.c')}), 9) AS d FROM v, p")
def dist_euclidean(spark, sf_dir):
    return _distances(spark, sf_dir, EUCLIDEAN)


@query(f"WITH {_V}, {_P} SELECT vec_id, i, round({_ABS.format(a='v.f', b='p.c')}, 9) AS d FROM v, p")
def dist_manhattan(spark, sf_dir):
    return _distances(spark, sf_dir, MANHATTAN)


@query(f"WITH {_V}, {_P} SELECT vec_id, i, round(1 - {_dot('v.f', 'p.c')} / (sqrt({_dot('v.f', 'v.f')}) * sqrt({_dot('p.c', 'p.c')})), 9) AS d FROM v, p")
def dist_cosine(spark, sf_dir):
    return _distances(spark, sf_dir, COSINE).withColumn("d", F.col("d") + 0.0)


@query(f"WITH {_V}, {_P} SELECT vec_id, i, round(1 - {_dot('v.f', 'p.c')}, 9) AS d FROM v, p")
def dist_unit_sphere(spark, sf_dir):
    return _distances(spark, sf_dir, UNIT_SPHERE)


@query(f"WITH {_V}, {_P} SELECT i, sum(CASE WHEN {_sq('v.f', 'p.c')} <= {EPS * EPS}::DOUBLE THEN w ELSE 0 END) AS mass, count(*) FILTER (WHERE {_sq('v.f', 'p.c')} <= {EPS * EPS}::DOUBLE) AS n FROM v, p GROUP BY i")
def within_radius(spark, sf_dir):
    v = vectors(spark, sf_dir)
    inside = v.select(WEIGHT, F.posexplode(F.array(*(EUCLIDEAN.within(F.col(FEATURES), literal(p), EPS) for p in drawn(v, K)))).alias("i", "inside"))
    return inside.groupBy("i").agg(F.sum(F.when(F.col("inside"), F.col(WEIGHT)).otherwise(0.0)).alias("mass"), F.count_if("inside").alias("n"))


@query(f"WITH {_V}, {_P}, t AS (SELECT i, sqrt({_sq('v.f', 'p.c')}) AS d FROM v, p) SELECT i, count(*) FILTER (WHERE d <= 1.3::DOUBLE) AS n, round(sum(CASE WHEN d <= 1.3::DOUBLE THEN d ELSE 0 END), 6) AS total FROM t GROUP BY i")
def distance_up_to(spark, sf_dir):
    v = vectors(spark, sf_dir)
    each = v.select(F.posexplode(F.array(*(EUCLIDEAN.up_to(F.col(FEATURES), literal(p), 1.3) for p in drawn(v, K)))).alias("i", "d"))
    near = F.col("d") < float("inf")
    return each.groupBy("i").agg(F.count_if(near).alias("n"), F.round(F.sum(F.when(near, F.col("d")).otherwise(0.0)), 6).alias("total"))


# --- labelling --------------------------------------------------------------------------------------------------


@query(f"WITH {_V}, {_P}, {_NEAR} SELECT vec_id, i AS prediction FROM near")
def assign_nearest(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return PrototypeModel(drawn(v, K), EUCLIDEAN).assign(v).select("vec_id", PREDICTION)


@query(f"WITH {_V}, {_P}, {_NEAR} SELECT vec_id, i AS prediction FROM near")
def assign_nearest_expression(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select("vec_id", PrototypeModel(drawn(v, K), EUCLIDEAN).expression(F.col(FEATURES)).alias(PREDICTION))


def _tree(c: np.ndarray) -> BisectingKMeansModel:
    """The drawn rows as a tree: (0, 1) and (2, 3) meet on the left, 4 and 5 on the right."""
    pair = lambda a, b: Node((c[a] + c[b]) / 2, Node(c[a]), Node(c[b]))
    left = pair(0, 1), pair(2, 3)
    return BisectingKMeansModel(Node(c.mean(axis=0), Node((left[0].center + left[1].center) / 2, *left), pair(4, 5)), EUCLIDEAN)


_MID = "list_transform(list_zip({a}, {b}), lambda z: (z[1] + z[2]) / 2)"


@query(
    f"""WITH {_V}, {_P}, c AS (SELECT max(CASE WHEN i=0 THEN c END) a, max(CASE WHEN i=1 THEN c END) b, max(CASE WHEN i=2 THEN c END) c, max(CASE WHEN i=3 THEN c END) d, max(CASE WHEN i=4 THEN c END) e, max(CASE WHEN i=5 THEN c END) g FROM p),
    m AS (SELECT *, {_MID.format(a='a', b='b')} AS ab, {_MID.format(a='c', b='d')} AS cd, {_MID.format(a='e', b='g')} AS eg FROM c), n AS (SELECT *, {_MID.format(a='ab', b='cd')} AS abcd FROM m)
    SELECT vec_id, (CASE WHEN {_sq('f', 'abcd')} <= {_sq('f', 'eg')} THEN CASE WHEN {_sq('f', 'ab')} <= {_sq('f', 'cd')} THEN CASE WHEN {_sq('f', 'a')} <= {_sq('f', 'b')} THEN 0 ELSE 1 END
    ELSE CASE WHEN {_sq('f', 'c')} <= {_sq('f', 'd')} THEN 2 ELSE 3 END END ELSE CASE WHEN {_sq('f', 'e')} <= {_sq('f', 'g')} THEN 4 ELSE 5 END END)::INT AS prediction FROM v, n"""
)
def assign_tree(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _tree(drawn(v, K)).assign(v).select("vec_id", PREDICTION)


_CORE = f"SELECT vec_id, i, d FROM (SELECT v.vec_id, p.i, {_sq('v.f', 'p.c')} AS d FROM v, p) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1"


@query(f"WITH {_V}, {_P}, n AS ({_CORE}) SELECT vec_id, (CASE WHEN d <= {EPS * EPS}::DOUBLE THEN i % 3 ELSE -1 END)::INT AS prediction FROM n")
def assign_core_eps(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return CoreLabelModel(drawn(v, K), np.arange(K) % 3, EPS, EUCLIDEAN, chunk=4).assign(v).select("vec_id", PREDICTION)


@query(f"WITH {_V}, {_P}, n AS ({_CORE}) SELECT vec_id, (i % 3)::INT AS prediction FROM n")
def assign_core_closest(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return CoreLabelModel(drawn(v, K), np.arange(K) % 3, EPS, EUCLIDEAN, False, chunk=4).assign(v).select("vec_id", PREDICTION)


# --- k-means ----------------------------------------------------------------------------------------------------


def _rounds(n: int) -> str:
    """SQL of n rounds of Lloyd from p: each a step's sums, then the new centres."""
    out, now = [], "p"
    for r in range(1, n + 1):
        out.append(f"a{r} AS (SELECT vec_id, f, w, i FROM (SELECT v.*, c.i, {_sq('v.f', 'c.c')} AS d FROM v, {now} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1)")
        out.append(f"s{r} AS (SELECT i, pos, sum(w * x) / sum(w) AS m FROM (SELECT i, w, unnest(f) AS x, unnest(range(1, len(f) + 1)) AS pos FROM a{r}) GROUP BY i, pos)")
        out.append(f"c{r} AS (SELECT o.i, coalesce(n.c, o.c) AS c FROM {now} o LEFT JOIN (SELECT i, list(m ORDER BY pos) AS c FROM s{r} GROUP BY i) n ON n.i = o.i)")
        now = f"c{r}"
    return ", ".join(out)


def _centres(spark, centres: np.ndarray) -> DataFrame:
    rows = [(i, j, float(round(x, 6))) for i, c in enumerate(centres) for j, x in enumerate(c)]
    return _frame(spark, rows, "i int, j int, x double")


@query(f"WITH {_V}, {_P}, {_rounds(1)} SELECT i, unnest(range(0, len(c)))::INT AS j, unnest(list_transform(c, lambda x: round(x, 6))) AS x FROM c1")
def lloyd_step(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _centres(spark, lloyd(with_weights(v), drawn(v, K), 1, 0.0, EUCLIDEAN_GEOMETRY)[0])


@query(f"WITH {_V}, {_P}, {_rounds(5)} SELECT i, unnest(range(0, len(c)))::INT AS j, unnest(list_transform(c, lambda x: round(x, 6))) AS x FROM c5")
def lloyd_5_rounds(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _centres(spark, KMeans(K, 5, 0.0).fit(v, drawn(v, K)).centroids)


@query(f"WITH {_V}, {_P}, {_rounds(3)} SELECT i AS prediction, count(*) AS rows, sum(w) AS mass FROM (SELECT vec_id, w, i FROM (SELECT v.vec_id, v.w, c.i, {_sq('v.f', 'c.c')} AS d FROM v, c3 c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1) GROUP BY i")
def kmeans_labels(spark, sf_dir):
    """The flagship: fit from drawn centres, label every row, count and weigh the clusters."""
    v = vectors(spark, sf_dir)
    model = KMeans(K, 3, 0.0).fit(v, drawn(v, K))
    return E.label_stats(E.labelled(model, v)).select(PREDICTION, "rows", "mass")


def _spherical(n: int) -> str:
    unit = lambda c: f"list_transform({c}, lambda x: x / sqrt({_dot(c, c)}))"
    out, now = [f"q AS (SELECT vec_id, w, {unit('f')} AS f FROM v)", f"c0 AS (SELECT i, {unit('c')} AS c FROM p)"], "c0"
    for r in range(1, n + 1):
        out.append(f"a{r} AS (SELECT vec_id, f, w, i FROM (SELECT q.*, c.i, 1 - {_dot('q.f', 'c.c')} AS d FROM q, {now} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1)")
        out.append(f"s{r} AS (SELECT i, pos, sum(w * x) / sum(w) AS m FROM (SELECT i, w, unnest(f) AS x, unnest(range(1, len(f) + 1)) AS pos FROM a{r}) GROUP BY i, pos)")
        out.append(f"l{r} AS (SELECT i, list(m ORDER BY pos) AS c FROM s{r} GROUP BY i), c{r} AS (SELECT o.i, coalesce({unit('n.c')}, o.c) AS c FROM {now} o LEFT JOIN l{r} n ON n.i = o.i)")
        now = f"c{r}"
    return ", ".join(out)


@query(f"WITH {_V}, {_P}, {_spherical(3)} SELECT i, unnest(range(0, len(c)))::INT AS j, unnest(list_transform(c, lambda x: round(x, 6))) AS x FROM c3")
def spherical_kmeans_3_rounds(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _centres(spark, KMeans(K, 3, 0.0, geometry=SPHERICAL_GEOMETRY).fit(v, drawn(v, K)).centroids)


@query()
def weighted_kmeans_lines(spark, sf_dir):
    """k-means over all line items, weighted by quantity."""
    t = lines(spark, sf_dir)
    model = KMeans(4, 10, 1e-3).fit(t)
    return E.label_stats(E.labelled(model, t))


@query(
    f"""WITH {_V}, {_P}, t AS (SELECT v.vec_id, v.w, p.i, {_sq('v.f', 'p.c')} AS d, row_number() OVER (PARTITION BY v.vec_id ORDER BY {_sq('v.f', 'p.c')}, p.i) AS r FROM v, p),
    b AS (SELECT vec_id, any_value(w) AS w, max(CASE WHEN r = 1 THEN i END) AS i, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2 FROM t GROUP BY vec_id)
    SELECT i, sum(w) AS mass, round(sum(w * d1), 6) AS error, round(sum(w * (d2 - d1)), 6) AS utility FROM b GROUP BY i"""
)
def breathing_statistics(spark, sf_dir):
    v = vectors(spark, sf_dir)
    stats = breathing_stats(with_weights(v), drawn(v, K), EUCLIDEAN_GEOMETRY)
    return _frame(spark, [(i, float(m), float(round(e, 6)), float(round(u, 6))) for i, (m, e, u) in enumerate(stats) if m > 0], "i int, mass double, error double, utility double")


@query(f"WITH {_V}, g AS (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, sum(w * x) / sum(w) AS m FROM (SELECT w, unnest(f) AS x, unnest(range(1, len(f) + 1)) AS pos FROM v) GROUP BY pos)) SELECT count(*)::DOUBLE AS rows, sum(w) AS mass, round(sum(w * {_sq('f', 'c')}), 6) AS cost FROM v, g")
def bisect_leaf_stats(spark, sf_dir):
    points = with_weights(vectors(spark, sf_dir))
    rows, mass, cost = leaf_stats(points, mean_of(points)[0], EUCLIDEAN_GEOMETRY)
    return _frame(spark, [(rows, mass, round(cost, 6))], "rows double, mass double, cost double")


@query(f"WITH {_V}, {_P}, t AS (SELECT vec_id, any_value(w) AS w, min({_sq('v.f', 'p.c')}) AS d FROM v, p WHERE p.i < 2 GROUP BY vec_id) SELECT round(sum(w * d), 6) AS cost FROM t")
def bisect_split_cost(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _frame(spark, [(round(split_cost(with_weights(v), drawn(v, K)[:2], EUCLIDEAN_GEOMETRY), 6),)], "cost double")


def _stats_of(model, v: DataFrame) -> DataFrame:
    return E.label_stats(E.labelled(model, v))


@query()
def breathing_kmeans(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _stats_of(BreathingKMeans(K, 2, 10, 1e-2, max_cycles=4).fit(v, drawn(v, K)), v)


@query()
def bisecting_kmeans(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _stats_of(BisectingKMeans(4, 5, 1e-2).fit(v), v)


# --- k-medoids --------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_V}, {_P}, t AS (SELECT vec_id, any_value(w) AS w, sqrt(min(CASE WHEN p.i < 3 THEN {_sq('v.f', 'p.c')} END)) AS a, sqrt(min(CASE WHEN p.i >= 3 THEN {_sq('v.f', 'p.c')} END)) AS b FROM v, p GROUP BY vec_id)
    SELECT 0 AS s, round(sum(w * a), 6) AS cost FROM t UNION ALL SELECT 1 AS s, round(sum(w * b), 6) AS cost FROM t"""
)
def medoid_cost_sets(spark, sf_dir):
    v = vectors(spark, sf_dir)
    c = drawn(v, K)
    costs = medoid_costs(with_weights(v), [c[:3], c[3:]], EUCLIDEAN)
    return _frame(spark, [(s, float(round(x, 6))) for s, x in enumerate(costs)], "s int, cost double")


_N = 60
_S = f"s AS (SELECT row_number() OVER (ORDER BY u, vec_id)::INT - 1 AS i, f, w FROM v QUALIFY i < {_N}), d AS (SELECT a.i, b.i AS j, a.w AS wi, b.w AS wj, sqrt({_sq('a.f', 'b.f')}) AS d FROM s a, s b)"


def _sample(spark, sf_dir) -> tuple[np.ndarray, np.ndarray]:
    """The operator's own bounded sample: rows and weights by hash of the id."""
    v = vectors(spark, sf_dir).withColumn("u", keyed_uniform(F.col("vec_id"), SEED)).orderBy("u", "vec_id").limit(_N)
    rows = v.select(FEATURES, WEIGHT, "u", "vec_id").collect()
    return np.array([r[FEATURES] for r in rows]), np.array([r[WEIGHT] for r in rows])


@query(
    f"""WITH {_V}, {_S}, m0 AS (SELECT i AS m FROM (SELECT i, sum(wj * d) AS c FROM d GROUP BY i) ORDER BY c, i LIMIT 1),
    m1 AS (SELECT c.i AS m FROM d c JOIN d n ON n.j = c.j, m0 WHERE n.i = m0.m AND c.i <> m0.m GROUP BY c.i ORDER BY sum(c.wj * greatest(0.0::DOUBLE, n.d - c.d)) DESC, c.i LIMIT 1),
    near AS (SELECT j, min(d) AS d FROM d WHERE i IN (SELECT m FROM m0 UNION ALL SELECT m FROM m1) GROUP BY j),
    m2 AS (SELECT c.i AS m FROM d c JOIN near n ON n.j = c.j WHERE c.i NOT IN (SELECT m FROM m0 UNION ALL SELECT m FROM m1) GROUP BY c.i ORDER BY sum(c.wj * greatest(0.0::DOUBLE, n.d - c.d)) DESC, c.i LIMIT 1)
    SELECT 0 AS slot, m FROM m0 UNION ALL SELECT 1, m FROM m1 UNION ALL SELECT 2, m FROM m2"""
)
def pam_build(spark, sf_dir):
    x, w = _sample(spark, sf_dir)
    return _frame(spark, [(s, m) for s, m in enumerate(build(distance_matrix(x, EUCLIDEAN), w, 3))], "slot int, m int")


@query(
    f"""WITH {_V}, {_S}, sets AS (SELECT h.i AS h, slot.s AS slot FROM s h, (SELECT unnest([0, 1, 2]) AS s) slot WHERE h.i > 2), now AS (SELECT sum(wj * m) AS c FROM (SELECT j, any_value(wj) AS wj, min(d) AS m FROM d WHERE i < 3 GROUP BY j)),
    t AS (SELECT h, slot, d.j, any_value(wj) AS wj, min(d.d) AS m FROM sets, d WHERE (d.i < 3 AND d.i <> slot) OR d.i = h GROUP BY h, slot, d.j)
    SELECT h, slot, round(sum(wj * m) - any_value(c), 6) + 0.0::DOUBLE AS delta FROM t, now GROUP BY h, slot"""
)
def swap_deltas(spark, sf_dir):
    """Change of the cost for every swap of the first three rows of the sample with another."""
    x, w = _sample(spark, sf_dir)
    d = distance_matrix(x, EUCLIDEAN)
    cache = Cache.of(d, [0, 1, 2])
    rows = [(h, s, float(round(c, 6)) + 0.0) for h in range(3, _N) for s, c in enumerate(deltas(d, w, cache, 3, h))]
    return _frame(spark, rows, "h int, slot int, delta double")


@query(
    f"""WITH {_V}, {_S}, {_P}, q AS (SELECT i, c FROM p WHERE i < 3), cand AS (SELECT i AS h, f, slot FROM (SELECT s.i, s.f, q.i AS slot, row_number() OVER (PARTITION BY s.i ORDER BY {_sq('s.f', 'q.c')}, q.i) AS r FROM s, q) WHERE r = 1),
    home AS (SELECT vec_id, f, w, slot FROM (SELECT v.*, q.i AS slot, row_number() OVER (PARTITION BY vec_id ORDER BY {_sq('v.f', 'q.c')}, q.i) AS r FROM v, q) WHERE r = 1)
    SELECT c.h, c.slot, round(sum(m.w * sqrt({_sq('m.f', 'c.f')})), 6) AS cost FROM cand c JOIN home m ON m.slot = c.slot GROUP BY c.h, c.slot"""
)
def medoid_refine_costs(spark, sf_dir):
    v = vectors(spark, sf_dir)
    slot, cost = candidate_costs(with_weights(v), drawn(v, K)[:3], _sample(spark, sf_dir)[0], EUCLIDEAN)
    return _frame(spark, [(h, int(s), float(round(c, 6))) for h, (s, c) in enumerate(zip(slot, cost, strict=True))], "h int, slot int, cost double")


@query()
def pam_solvers(spark, sf_dir):
    """Best-swap and eager-swap searches on one sample; their costs may differ in a local optimum only."""
    x, w = _sample(spark, sf_dir)
    found = [("fastpam", FastPAM(3, 100, EUCLIDEAN).fit_local(x, w)), ("fasterpam", FasterPAM(3, 100, EUCLIDEAN).fit_local(x, w))]
    return _frame(spark, [(n, float(round(s.cost, 6)), s.iterations) for n, s in found], "solver string, cost double, iterations int")


@query()
def clara(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _stats_of(CLARA(4, 3, 200, metric=EUCLIDEAN, inner="fasterpam").fit(v), v)


@query()
def pamae(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _stats_of(PAMAE(4, 3, 200, pool_size=300, metric=MANHATTAN, inner="fasterpam").fit(v), v)


# --- samples ----------------------------------------------------------------------------------------------------


@query(f"WITH {_V} SELECT vec_id, round(pow(u, 1.0::DOUBLE / w), 12) AS score FROM v ORDER BY pow(u, 1.0::DOUBLE / w) DESC, vec_id LIMIT 20")
def ares_init(spark, sf_dir):
    u = keyed_uniform(F.col("vec_id"), SEED)
    return _rounded(weighted_top_rows(vectors(spark, sf_dir), 20, u).select("vec_id", ares_key(u, F.col(WEIGHT)).alias("score")), 12, "score")


@query("SELECT s::INT AS sample_id, vec_id FROM embeddings, (SELECT unnest([0, 1, 2, 3, 4]) AS s) WHERE ('0x' || substr(md5(vec_id::VARCHAR || '|' || (42 + s)::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.26::DOUBLE")
def clara_samples(spark, sf_dir):
    """Five independent samples of all rows in one scan, a row by its own number in each: a fifth of the rows and the slack of 0.3, however many there are."""
    return chance_samples(vectors(spark, sf_dir), 5, 0.26, SEED, lambda seed: keyed_uniform(F.col("vec_id"), seed)).select("sample_id", "vec_id")


@query(f"WITH {_V}, n AS (SELECT greatest(1, least(count(*), ceil(0.3 * count(*))))::BIGINT AS m FROM v) SELECT vec_id FROM v, n QUALIFY row_number() OVER (ORDER BY u, vec_id) <= m")
def dbscanpp_candidates(spark, sf_dir):
    """Exactly the asked-for share of rows as candidates, whatever their order or weight."""
    v = vectors(spark, sf_dir)
    rows = v.count()
    return candidate_rows(v, candidate_count(0.3, rows), rows, keyed_uniform(F.col("vec_id"), SEED)).select("vec_id")


_CM = "mu AS (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, sum(w * x) / sum(w) AS m FROM (SELECT w, unnest(f) AS x, unnest(range(1, len(f) + 1)) AS pos FROM v) GROUP BY pos)), cs AS (SELECT sum(w) AS mass, sum(w * " + _sq("f", "c") + ") AS disp, any_value(c) AS c FROM v, mu)"


@query(f"WITH {_V}, {_CM} SELECT round(mass, 6) AS mass, round(disp, 6) AS dispersion FROM cs")
def coreset_moment_sums(spark, sf_dir):
    _, mass, spread = coreset_moments(with_weights(vectors(spark, sf_dir)), EUCLIDEAN)
    return _frame(spark, [(round(mass, 6), round(spread, 6))], "mass double, dispersion double")


@query(f"WITH {_V}, {_CM}, t AS (SELECT vec_id, u, w, least(1.0::DOUBLE, 100.0::DOUBLE * w * (1 / (2 * mass) + {_sq('f', 'c')} / (2 * disp))) AS pi FROM v, cs) SELECT vec_id, round(w / pi, 6) AS weight FROM t WHERE u < pi")
def coreset_draw(spark, sf_dir):
    v = vectors(spark, sf_dir)
    mean, mass, spread = coreset_moments(with_weights(v), EUCLIDEAN)
    drawn = coreset_rows(v, 100, EUCLIDEAN, mean, mass, spread, keyed_uniform(F.col("vec_id"), SEED))
    return _rounded(drawn.select("vec_id", WEIGHT), 6, WEIGHT)


@query(f"WITH {_V}, n AS (SELECT count(*) AS n FROM v) SELECT vec_id FROM v, n WHERE n <= 150 OR u < 150 / n::DOUBLE")
def silhouette_sample_rows(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return silhouette_sample(v, 150, SEED, float(v.count()), False, keyed_uniform(F.col("vec_id"), SEED)).select("vec_id")


@query(f"WITH {_V}, n AS (SELECT sum(w) AS m FROM v), t AS (SELECT vec_id, u, greatest(0, least(w * 150 / m, 150.0::DOUBLE)) AS l FROM v, n) SELECT vec_id, (floor(l) + CASE WHEN u < l - floor(l) THEN 1 ELSE 0 END)::BIGINT AS copies FROM t WHERE floor(l) + CASE WHEN u < l - floor(l) THEN 1 ELSE 0 END > 0")
def silhouette_sample_weighted(spark, sf_dir):
    v = vectors(spark, sf_dir)
    total = v.agg(F.sum(WEIGHT)).first()[0]
    return silhouette_sample(v, 150, SEED, total, True, keyed_uniform(F.col("vec_id"), SEED)).groupBy("vec_id").agg(F.count("*").alias("copies"))


@query()
def coreset_kmeans(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _stats_of(Coreset(4, 200, LocalLloyd(4, 20)).fit(v), v)


@query()
def coreset_medoids(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _stats_of(Coreset(4, 200, LocalMedoids(4, COSINE, "fasterpam")).fit(v), v)


# --- density ----------------------------------------------------------------------------------------------------

_PAIRS = f"e AS (SELECT a.vec_id AS a, b.vec_id AS b, b.w FROM v a, v b WHERE {_sq('a.f', 'b.f')} <= {EPS * EPS}::DOUBLE)"
_CORES = f"core AS (SELECT a AS c FROM e GROUP BY a HAVING sum(w) >= {MIN_PTS}::DOUBLE)"
_COMP = f"""link AS (SELECT a, b FROM e WHERE a IN (SELECT c FROM core) AND b IN (SELECT c FROM core)), reach(a, b) AS (SELECT c, c FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    comp AS (SELECT a AS c, dense_rank() OVER (ORDER BY min(b))::INT - 1 AS cluster FROM reach GROUP BY a)"""


def _ordered(v: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids, x = collected(v.orderBy("vec_id"), "vec_id", FEATURES)
    return ids, x


@query(f"WITH {_V}, {_PAIRS} SELECT a AS vec_id, sum(w) AS density FROM e GROUP BY a")
def dbscan_density(spark, sf_dir):
    v = vectors(spark, sf_dir)
    ids, x = _ordered(v)
    return _frame(spark, [(int(i), float(d)) for i, d in zip(ids, densities(with_weights(v), x, EPS, EUCLIDEAN), strict=True)], "vec_id long, density double")


def _cores(spark, sf_dir) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    v = vectors(spark, sf_dir)
    ids, x = _ordered(v)
    core = densities(with_weights(v), x, EPS, EUCLIDEAN) >= MIN_PTS
    return v, ids[core], x[core]


@query(f"WITH {_V}, {_PAIRS}, {_CORES} SELECT c AS vec_id FROM core")
def dbscan_core_points(spark, sf_dir):
    return _frame(spark, [(int(i),) for i in _cores(spark, sf_dir)[1]], "vec_id long")


@query(f"WITH RECURSIVE {_V}, {_PAIRS}, {_CORES}, {_COMP} SELECT c AS vec_id, cluster FROM comp")
def dbscan_components(spark, sf_dir):
    return core_components(with_weights(vectors(spark, sf_dir), "vec_id"), "vec_id", EPS, MIN_PTS, EUCLIDEAN)


@query(
    f"""WITH RECURSIVE {_V}, {_PAIRS}, {_CORES}, {_COMP}, n AS (SELECT v.vec_id, o.cluster, {_sq('v.f', 'x.f')} AS d, o.c FROM v, comp o JOIN v x ON x.vec_id = o.c)
    SELECT vec_id, (CASE WHEN d <= {EPS * EPS}::DOUBLE THEN cluster ELSE -1 END)::INT AS prediction FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1"""
)
def dbscan_labels(spark, sf_dir):
    v, _, x = _cores(spark, sf_dir)
    return CoreLabelModel(x, epsilon_components(spark, x, EPS, EUCLIDEAN), EPS, EUCLIDEAN).assign(v).select("vec_id", PREDICTION)


@query()
def dbscanpp(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _stats_of(DBSCANpp(EPS, MIN_PTS, 0.4, metric=EUCLIDEAN).fit(v), v)


# --- evaluation on the labels the table has ---------------------------------------------------------------------


def _by_label(spark, sf_dir) -> DataFrame:
    return E.labelled(LabelColumnModel("label"), vectors(spark, sf_dir))


@query("SELECT label::INT AS prediction, count(*) AS rows, sum((vec_id % 5 + 1)::DOUBLE) AS mass FROM embeddings GROUP BY label")
def label_stats(spark, sf_dir):
    return E.label_stats(_by_label(spark, sf_dir))


@query("SELECT count(DISTINCT label)::BIGINT AS n_clusters, 0.0::DOUBLE AS noise_fraction FROM embeddings")
def cluster_counts(spark, sf_dir):
    rows = _by_label(spark, sf_dir)
    return rows.agg(F.count_distinct(F.when(F.col(PREDICTION) >= 0, F.col(PREDICTION))).alias("n_clusters"), (F.count_if(F.col(PREDICTION) == NOISE) / F.count("*")).alias("noise_fraction"))


@query(f"WITH {_V} SELECT label::INT AS prediction, pos::INT AS j, round(sum(w * x) / sum(w), 6) AS x FROM (SELECT label, w, unnest(f) AS x, unnest(range(0, len(f))) AS pos FROM v) GROUP BY label, pos")
def cluster_means(spark, sf_dir):
    return _rounded(E.weighted_means(_by_label(spark, sf_dir)).select(PREDICTION, F.posexplode("center").alias("j", "x")), 6, "x")


_MOM = f"""cen AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, sum(w * x) / sum(w) AS m FROM (SELECT label, w, unnest(f) AS x, unnest(range(1, len(f) + 1)) AS pos FROM v) GROUP BY label, pos) GROUP BY label),
    mom AS (SELECT v.label, any_value(c) AS c, sum(w) AS mass, sum(w * sqrt({_sq('f', 'c')})) AS d, sum(w * {_sq('f', 'c')}) AS q FROM v JOIN cen ON cen.label = v.label GROUP BY v.label)"""


@query(f"WITH {_V}, {_MOM} SELECT label::INT AS prediction, mass, round(d, 6) AS distance, round(q, 6) AS square FROM mom")
def distance_moments(spark, sf_dir):
    found = E.moments(LabelColumnModel("label"), _by_label(spark, sf_dir), EUCLIDEAN)
    return _frame(spark, [(m.label, m.mass, float(round(m.distance, 6)), float(round(m.square, 6))) for m in found], "prediction int, mass double, distance double, square double")


@query(f"WITH {_V}, {_MOM}, r AS (SELECT a.label, max((a.d / a.mass + b.d / b.mass) / sqrt({_sq('a.c', 'b.c')})) AS r FROM mom a, mom b WHERE a.label <> b.label GROUP BY a.label) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def davies_bouldin(spark, sf_dir):
    found = E.moments(LabelColumnModel("label"), _by_label(spark, sf_dir), EUCLIDEAN)
    return _frame(spark, [(round(E.davies_bouldin(found, EUCLIDEAN), 6),)], "davies_bouldin double")


@query(
    f"""WITH {_V}, {_MOM}, g AS (SELECT list(m ORDER BY pos) AS g FROM (SELECT pos, sum(mass * x) / sum(mass) AS m FROM (SELECT mass, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS pos FROM mom) GROUP BY pos))
    SELECT round((sum(mass * {_sq('c', 'g')}) / (count(*) - 1)) / (sum(q) / (sum(mass) - count(*))), 6) AS calinski_harabasz FROM mom, g"""
)
def calinski_harabasz(spark, sf_dir):
    found = E.moments(LabelColumnModel("label"), _by_label(spark, sf_dir), EUCLIDEAN)
    return _frame(spark, [(round(E.calinski_harabasz(found, EUCLIDEAN), 6),)], "calinski_harabasz double")


@query(
    f"""WITH {_V}, m AS (SELECT label, sum(w) AS mass FROM v GROUP BY label), t AS (SELECT a.vec_id, a.label, a.w, b.label AS other, sum(b.w * sqrt({_sq('a.f', 'b.f')})) AS t FROM v a, v b GROUP BY a.vec_id, a.label, a.w, b.label),
    s AS (SELECT t.vec_id, t.w, max(CASE WHEN t.other = t.label THEN t.t / (m.mass - least(1.0::DOUBLE, t.w)) END) AS a, min(CASE WHEN t.other <> t.label THEN t.t / m.mass END) AS b FROM t JOIN m ON m.label = t.other GROUP BY t.vec_id, t.w)
    SELECT count(*) AS scored, round(sum(w * (b - a) / greatest(a, b)) / sum(w), 6) AS silhouette FROM s"""
)
def silhouette(spark, sf_dir):
    got = E.silhouette(_by_label(spark, sf_dir), EUCLIDEAN)
    return _frame(spark, [(got.scored, round(got.score, 6))], "scored long, silhouette double")


@query()
def run_config(spark, sf_dir):
    """A whole run, from a configuration to a result, as one row of its quality fields."""
    from .plans.config import RunConfig
    from .plans.runner import run

    doc = {
        "runId": "registered", "dataset": {"type": "parquet", "params": {"path": f"{sf_dir}/embeddings.parquet", "featureColumnName": "embedding"}}, "algorithm": {"name": "kmeans", "params": {"k": 4, "maxIter": 3}},
        "evaluation": {"metrics": ["silhouette", "daviesBouldin", "calinskiHarabasz", "nClusters", "clusterSizes", "noiseFraction"], "sampleSize": 300},
    }
    got = run(RunConfig.of(doc), spark)
    if got["status"] != "ok":
        raise RuntimeError(got["errorMessage"])
    return _frame(spark, [(got["nRows"], got["nClusters"], got["iterationsRun"], got["silhouetteScoredPoints"])], "n_rows long, n_clusters int, iterations_run int, scored int")


@query(f"WITH {_V}, {_P}, t AS (SELECT vec_id, list_sort(list({_sq('v.f', 'p.c')})) AS d FROM v, p GROUP BY vec_id) SELECT vec_id, round(d[1], 9) AS d1, round(d[2], 9) AS d2 FROM t")
def nearest_two(spark, sf_dir):
    v = vectors(spark, sf_dir)
    d = nearest_ordinals(F.col(FEATURES), drawn(v, K), EUCLIDEAN, 2)
    return v.select("vec_id", d.alias("d")).select("vec_id", F.round(F.col("d")[0], 9).alias("d1"), F.round(F.col("d")[1], 9).alias("d2"))
