"""Queries over the driver's tables, one or more for each operator, and the equivalent SQL where there is one."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import udfs
from ..functions import vectors as V
from ..operators import atlas, learning, lineage, metrics, paths, search, spectral, store, tangent
from ..sources import files
from . import mql

DIM, AMBIENT = 8, 64
DIAGONAL = tuple(1.0 + (i % 4) / 4 for i in range(AMBIENT))
ROTATION = tuple(tuple(1.0 if j == (i + 1) % DIM else 0.0 for j in range(DIM)) for i in range(DIM))
#: The same with one axis turned round, so that it is a rotation without reflection.
PROPER = tuple(tuple(-x for x in row) if i == DIM - 1 else row for i, row in enumerate(ROTATION))
SHIFT = tuple(0.01 * i for i in range(DIM))
EDGES = tuple((i, (3 * i + 1) % 10) for i in range(10) if i != (3 * i + 1) % 10)
RADII = (1.1, 1.2, 1.3, 1.4)
#: Anchors are every 50th row, or fewer: at most about 1000 for any number of rows.
ANCHOR_STEP, MOST_ANCHORS = 50, 1000
_STEP_SQL = f"greatest({ANCHOR_STEP}, (SELECT count(*) FROM embeddings) // {MOST_ANCHORS})"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_P = "WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v AS qv, label AS ql FROM p WHERE vec_id = 0)"


def _register(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", V.as_vector(F.col("embedding")).alias("vector"))


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return list(points(spark, sf).where(F.col("vec_id") == vec_id).first()["vector"])


def _local(dim: int = DIM, vec: str = "vector"):
    return F.slice(F.col(vec), 1, dim)


def _neat(col: str, digits: int):
    """Rounded, and without negative zeros."""
    return F.transform(col, lambda x: F.round(x, digits) + F.lit(0.0)).alias(col)


def _half_away(x, digits: int):
    """Rounded by the scaled double as SQL does it, not by its shortest decimals; they differ where a double is nearly a tie."""
    return F.signum(x) * F.floor(F.abs(x) * 10.0**digits + 0.5) / 10.0**digits


def _out(df: DataFrame, *cols: str, rounded: str = "distance") -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in rounded.split() else F.col(c) for c in cols])


def _list(values) -> str:
    return "[" + ", ".join(_list(v) if isinstance(v, (list, tuple)) else repr(float(v)) for v in values) + "]"


# Nearest neighbours (S, D, L).

_METRIC_SQL = {"euclidean": "list_distance(v, qv)", "cosine": "list_cosine_distance(v, qv)", "manhattan": "list_sum(list_transform(range(1, 65), lambda i: abs(v[i] - qv[i])))"}


def _knn_query(metric: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _out(search.knn(points(spark, sf), query_vector(spark, sf), 10, metric), "vec_id", "distance")

    run.__name__ = f"knn_{metric}"
    _register(f"{_P} SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {_METRIC_SQL[metric]} AS d FROM p, q) ORDER BY d, vec_id LIMIT 10")(run)


for _m in _METRIC_SQL:
    _knn_query(_m)

_BATCH = """, b AS (SELECT a.vec_id AS query_id, p.vec_id, list_distance(a.v, p.v) AS d FROM p a, p WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM b)"""


def _queries_of(p: DataFrame) -> DataFrame:
    return p.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")


@_register(f"{_P}{_BATCH} SELECT query_id, rank::INT AS rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 5")
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return _out(search.knn_batch(p, _queries_of(p), 5), "query_id", "rank", "vec_id", "distance")


@_register(f"{_P} SELECT vec_id, round(list_distance(v, qv), 6) AS distance FROM p, q WHERE list_distance(v, qv) <= 1.3")
def ball_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    return _out(search.ball(points(spark, sf), query_vector(spark, sf), 1.3), "vec_id", "distance")


@_register(f"{_P} SELECT vec_id, round(list_cosine_distance(v, qv), 6) AS distance FROM p, q WHERE list_cosine_distance(v, qv) <= 0.9 ORDER BY 2, 1")
def range_exact(spark: SparkSession, sf: str) -> DataFrame:
    engine = mql.Engine(spark, {"points": points(spark, sf)})
    return _out(engine.execute(mql.Builder().range(query_vector(spark, sf), 0.9).using_metric("cosine").build()), "vec_id", "distance")


_TANGENT = "list_distance(v[1:8], qv[1:8])"


@_register(f"{_P} SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {_TANGENT} AS d FROM p, q ORDER BY d, vec_id LIMIT 20) WHERE d <= 0.35")
def tangent_topk_eps(spark: SparkSession, sf: str) -> DataFrame:
    engine = mql.Engine(spark, {"points": points(spark, sf)}, tangent_dim=DIM)
    return _out(engine.execute(mql.Builder().tangent_query(query_vector(spark, sf), 0.35).top_k(20).build()), "vec_id", "distance")


@_register(f"{_P} SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, list_distance(v, qv) AS d FROM p, q) WHERE d <= 1.2 ORDER BY d, vec_id LIMIT 25")
def knn_max_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _out(search.knn(points(spark, sf), query_vector(spark, sf), 25, max_distance=1.2), "vec_id", "distance")


@_register(f"{_P} SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - qv[i]) * (v[i] - qv[i]) * {_list(DIAGONAL)}[i]))) AS d FROM p, q) ORDER BY d, vec_id LIMIT 10")
def knn_diag_metric(spark: SparkSession, sf: str) -> DataFrame:
    return _out(search.knn_by(points(spark, sf), query_vector(spark, sf), 10, V.diagonal(DIAGONAL)), "vec_id", "distance")


_CONFORMAL = "sqrt((1 + list_sum(list_transform(range(1, 65), lambda i: ((v[i] + qv[i]) / 2) ** 2))) * list_sum(list_transform(range(1, 65), lambda i: (v[i] - qv[i]) ** 2)))"


@_register(f"{_P} SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {_CONFORMAL} AS d FROM p, q) ORDER BY d, vec_id LIMIT 10")
def knn_conformal_midpoint(spark: SparkSession, sf: str) -> DataFrame:
    return _out(search.knn_by(points(spark, sf), query_vector(spark, sf), 10, V.conformal), "vec_id", "distance")


@_register(f"{_P} SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, list_distance(v, qv) AS d FROM (SELECT vec_id, v, qv FROM p, q ORDER BY {_TANGENT}, vec_id LIMIT 50)) ORDER BY d, vec_id LIMIT 10")
def rerank_metric(spark: SparkSession, sf: str) -> DataFrame:
    def proxy(a, b):
        return V.euclidean(F.slice(a, 1, DIM), F.slice(b, 1, DIM))

    return _out(search.rerank(points(spark, sf), query_vector(spark, sf), 10, proxy, V.euclidean), "vec_id", "distance")


@_register(f"{_P} SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, list_distance(v, qv) AS d FROM p, q) ORDER BY d, vec_id LIMIT 7")
def knn_geodesic_flat(spark: SparkSession, sf: str) -> DataFrame:
    q = ", ".join(repr(x) for x in query_vector(spark, sf))
    text = f"SELECT vec_id, distance FROM points USING metric 'geodesic' WHERE geodesic_distance(vector, [{q}]) < 10 LIMIT 7"
    return _out(mql.Engine(spark, {"points": points(spark, sf)}).sql(text), "vec_id", "distance")


@_register(f"{_P} SELECT vec_id, round(d, 6) AS distance, round(list_distance(v, qv), 6) AS residual FROM (SELECT vec_id, v, qv, {_TANGENT} AS d FROM p, q WHERE label = 1) ORDER BY d, vec_id LIMIT 10")
def cross_modal_same_frame(spark: SparkSession, sf: str) -> DataFrame:
    q = V.literal(query_vector(spark, sf))
    rows = points(spark, sf).where("label = 1").withColumn("distance", V.euclidean(_local(), F.slice(q, 1, DIM))).withColumn("residual", V.euclidean(F.col("vector"), q))
    return _out(search.top_k(rows, 10), "vec_id", "distance", "residual", rounded="distance residual")


_MOVED = f"list_transform(range(1, 9), lambda i: qv[i % 8 + 1] + {_list(SHIFT)}[i])"


@_register(f"{_P} SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, list_distance(v[1:8], {_MOVED}) AS d FROM p, q WHERE label = 2) ORDER BY d, vec_id LIMIT 10")
def cross_modal_transport(spark: SparkSession, sf: str) -> DataFrame:
    local = points(spark, sf).select("vec_id", F.col("label").cast("string").alias("modality"), _local().alias("vector"))
    engine = mql.Engine(spark, {"points": local}, {("0", "2"): (ROTATION, SHIFT)})
    return _out(engine.execute(mql.Builder().cross_modal("0", "2", query_vector(spark, sf)[:DIM]).build()), "vec_id", "distance")


@_register(f"{_P} SELECT vec_id, label FROM p WHERE label = 3 ORDER BY vec_id LIMIT 20")
def scan_filter_limit(spark: SparkSession, sf: str) -> DataFrame:
    engine = mql.Engine(spark, {"points": points(spark, sf)})
    return engine.execute(mql.Builder().select("vec_id", "label").with_metadata(label=3).order_by("vec_id").limit(20).build())


@_register(f"{_P} SELECT vec_id, label, round(list_distance(v, qv), 6) AS distance FROM p, q ORDER BY list_distance(v, qv) DESC, vec_id LIMIT 15")
def order_by_distance(spark: SparkSession, sf: str) -> DataFrame:
    q = mql.Query(fields=("vec_id", "label", "distance"), point=tuple(query_vector(spark, sf)), order_by="distance", descending=True, limit=15)
    return _out(mql.Engine(spark, {"points": points(spark, sf)}).execute(q), "vec_id", "label", "distance")


_FISHER = "2 * acos(least(1, list_sum(list_transform(range(1, 65), lambda i: sqrt(x.w[i] * y.w[i]))) / sqrt(list_sum(x.w) * list_sum(y.w))))"


@_register(f"{_P}, a AS (SELECT vec_id, list_transform(v, lambda x: abs(x)) AS w FROM p), d AS (SELECT x.vec_id AS query_id, y.vec_id, {_FISHER} AS d FROM a x, a y WHERE x.vec_id % 20 = 0 AND x.vec_id <> y.vec_id) SELECT query_id, vec_id, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM d) WHERE r <= 5")
def knn_fisher_rao(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).select("vec_id", F.transform("vector", F.abs).alias("vector"))
    found = search.knn_batch(rows, _queries_of(rows), 5, "fisher_rao", drop_self=True)
    return found.select("query_id", "vec_id", F.round("distance", 5).alias("distance"))


@_register(f"{_P} SELECT x.vec_id, round({_FISHER.replace('x.w', 'w').replace('y.w', 'u')}, 5) AS distance FROM (SELECT a.vec_id, list_transform(a.v, lambda c: abs(c)) AS w, list_transform(b.v, lambda c: abs(c)) AS u FROM p a JOIN p b ON b.vec_id = a.vec_id + 1) x")
def fisher_rao_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Fisher-Rao distance of every row to the next."""
    rows = _following(points(spark, sf).select("vec_id", F.transform("vector", F.abs).alias("vector")))
    return rows.select(F.col("i").alias("vec_id"), F.round(V.fisher_rao(F.col("a"), F.col("b")), 5).alias("distance"))


def _following(rows: DataFrame, reach: int = 1) -> DataFrame:
    """(i, j, a, b): every row with the `reach` rows whose ids come next, by an equi-join."""
    left = rows.select(F.col("vec_id").alias("i"), F.col("vector").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("n"))
    return left.withColumn("j", F.col("i") + F.col("n")).join(rows.select(F.col("vec_id").alias("j"), F.col("vector").alias("b")), "j").select("i", "j", "a", "b")


@_register(f"{_P} SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.v, b.v), 6) AS distance FROM p a, p b WHERE a.vec_id % 20 = 0")
def distance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return search.batch_distances(p, _queries_of(p)).select(F.col("query_id").alias("i"), F.col("vec_id").alias("j"), F.round("distance", 6).alias("distance"))


@_register(f"{_P} SELECT count(*) AS n FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 JOIN p c ON c.vec_id = b.vec_id + 1 WHERE list_distance(a.v, c.v) > list_distance(a.v, b.v) + list_distance(b.v, c.v) + 1e-9")
def triangle_check(spark: SparkSession, sf: str) -> DataFrame:
    """Over the triangles of every three rows in a row."""
    sides = _following(points(spark, sf), 2).select("i", "j", V.euclidean(F.col("a"), F.col("b")).alias("distance"))
    return paths.triangle_violations(sides).agg(F.count("*").alias("n"))


@_register()
def sinkhorn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Optimal transport cost and W2 of every row to the next."""
    rows = _following(points(spark, sf).select("vec_id", F.transform(_local(), F.abs).alias("vector")))
    return rows.select(F.col("i").alias("a"), F.col("j").alias("b"), udfs.sinkhorn(F.col("a"), F.col("b")).alias("cost"), udfs.wasserstein(F.col("a"), F.col("b")).alias("w2"))


@_register(f"{_P}, m AS (SELECT vec_id, 1 + abs(v[1]) AS a, v[2] / 4 AS b, 1 + abs(v[3]) AS c FROM p), e AS (SELECT vec_id, (a + c) / 2 AS t, sqrt(((a - c) / 2) ** 2 + b * b) AS r FROM m) SELECT vec_id, round(sqrt(ln(t + r) ** 2 + ln(t - r) ** 2), 6) AS distance FROM e")
def log_euclidean_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of a 2 x 2 matrix to the identity, by its name in the query language."""
    spd = F.array(1 + F.abs(F.get("vector", F.lit(0))), F.get("vector", F.lit(1)) / 4, F.get("vector", F.lit(1)) / 4, 1 + F.abs(F.get("vector", F.lit(2))))
    engine = mql.Engine(spark, {"points": points(spark, sf).select("vec_id", spd.alias("vector"))})
    return _out(engine.sql("SELECT vec_id, distance FROM points USING METRIC log_euclidean WHERE geodesic_distance(vector, [1, 0, 0, 1]) < 100"), "vec_id", "distance")


# Charts and anchors (C, S13-S15, T).


@_register(f"{_P} SELECT vec_id, list_transform(v[1:8], lambda x: round(x, 6) + 0) AS local FROM p")
def default_chart_project(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("vec_id", F.transform(_local(), lambda x: F.round(x, 6)).alias("local"))


@_register(f"{_P} SELECT vec_id, round(sqrt(list_sum(list_transform(v[9:64], lambda x: x * x))), 6) AS residual FROM p")
def default_chart_residual(spark: SparkSession, sf: str) -> DataFrame:
    back = V.padded(_local(), AMBIENT)
    return points(spark, sf).select("vec_id", F.round(V.euclidean(F.col("vector"), back), 6).alias("residual"))


def label_charts(spark: SparkSession, sf: str) -> list[tuple]:
    """One chart per label: its mean as origin, the first axes as basis. Labels are few by definition."""
    cells = F.array(*[F.avg(F.get("vector", F.lit(i))) for i in range(AMBIENT)])
    basis = [[1.0 if j == i else 0.0 for j in range(AMBIENT)] for i in range(DIM)]
    return [(int(r[0]), list(r[1]), basis) for r in points(spark, sf).groupBy("label").agg(cells).orderBy("label").collect()]


_CHARTS = f"{_P}, c AS (SELECT label AS chart_id, list(m ORDER BY i) AS o FROM (SELECT label, i, avg(v[i]) AS m FROM p, range(1, 65) t(i) GROUP BY label, i) GROUP BY label), s AS (SELECT vec_id, chart_id, list_distance(v[9:64], o[9:64]) AS d FROM p, c), l AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), chart_id) AS k FROM s)"


def _located(spark: SparkSession, sf: str, keep: int = 1) -> DataFrame:
    charts = spark.createDataFrame(label_charts(spark, sf), atlas.CHARTS)
    return atlas.locate(points(spark, sf), charts, keep=keep)


@_register(f"{_CHARTS} SELECT vec_id, chart_id, round(d, 6) AS residual FROM l WHERE k = 1")
def locate_chart(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_located(spark, sf), "vec_id", "chart_id", "residual", rounded="residual")


@_register(f"{_CHARTS} SELECT chart_id, count(*) AS n, sum((d2 < 1.1 * d)::BIGINT)::BIGINT AS near_ties FROM (SELECT vec_id, max(CASE WHEN k = 1 THEN chart_id END) AS chart_id, max(CASE WHEN k = 1 THEN d END) AS d, max(CASE WHEN k = 2 THEN d END) AS d2 FROM l WHERE k <= 2 GROUP BY vec_id) GROUP BY chart_id")
def chart_coverage(spark: SparkSession, sf: str) -> DataFrame:
    two = _located(spark, sf, 2).groupBy("vec_id").agg(*[F.max(F.when(F.col("rank") == r, F.col(c))).alias(n) for r, c, n in ((1, "chart_id", "chart_id"), (1, "residual", "d"), (2, "residual", "d2"))])
    return two.groupBy("chart_id").agg(F.count("*").alias("n"), F.sum((F.col("d2") < 1.1 * F.col("d")).cast("long")).alias("near_ties"))


_BOX = f"{_P}, m AS (SELECT label, i, min(v[i]) AS lo, max(v[i]) AS hi, avg(v[i]) AS c FROM p, range(1, 4) t(i) GROUP BY label, i), b AS (SELECT label AS chart, list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi, list(c ORDER BY i) AS c, product(hi - lo) AS volume FROM m GROUP BY label), x AS (SELECT vec_id, chart, volume, c, v, v[1] BETWEEN lo[1] AND hi[1] AND v[2] BETWEEN lo[2] AND hi[2] AND v[3] BETWEEN lo[3] AND hi[3] AS inside FROM p, b)"


@_register(f"{_BOX} SELECT chart, count(*) AS n_inside FROM x WHERE inside GROUP BY chart")
def chart_bbox_contains(spark: SparkSession, sf: str) -> DataFrame:
    boxes = atlas.bounds(points(spark, sf), "label", 3)
    pairs = points(spark, sf).select("vector").crossJoin(search.checked(boxes))
    return pairs.where(atlas.inside(_local(3), F.col("lo"), F.col("hi"))).groupBy(F.col("label").alias("chart")).agg(F.count("*").alias("n_inside"))


@_register(f"{_BOX} SELECT vec_id, chart, inside AS contained FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY inside DESC, CASE WHEN inside THEN volume ELSE list_distance(v[1:3], c) END, chart) AS k FROM x) WHERE k = 1")
def find_chart_smallest_bbox(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    centres = p.groupBy("label").agg(F.array(*[F.avg(F.get("vector", F.lit(i))) for i in range(3)]).alias("centroid"))
    return atlas.find_chart(p, atlas.bounds(p, "label", 3), centres, "label", 3)


def _sampled(rows: DataFrame) -> DataFrame:
    """The rows that serve as anchors; vec_id counts up, so their number is bounded."""
    return rows.where(F.col("vec_id") % F.lit(max(ANCHOR_STEP, rows.count() // MOST_ANCHORS)) == 0)


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(points(spark, sf)).select(F.col("vec_id").alias("anchor_id"), F.col("vector").alias("base"))


_ANCHORS = f"{_P}, a AS (SELECT vec_id AS anchor_id, v AS base FROM p WHERE vec_id % {_STEP_SQL} = 0), s AS (SELECT vec_id, v, anchor_id, base, list_distance(v, base) AS ad FROM p, a), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ad, anchor_id) AS k FROM s) WHERE k = 1)"


@_register(f"{_ANCHORS} SELECT vec_id, anchor_id, round(ad, 6) AS anchor_distance FROM n")
def anchor_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _out(search.assign_anchors(points(spark, sf), _anchors(spark, sf)), "vec_id", "anchor_id", "anchor_distance", rounded="anchor_distance")


@_register(f"{_ANCHORS} SELECT anchor_id, count(*) AS n, round(min(ad), 6) AS min_d, round(max(ad), 6) AS max_d, round(avg(ad), 6) AS avg_d FROM n GROUP BY anchor_id")
def anchor_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _out(search.anchor_stats(search.assign_anchors(points(spark, sf), _anchors(spark, sf))), "anchor_id", "n", "min_d", "max_d", "avg_d", rounded="min_d max_d avg_d")


_PROBE = f"{_ANCHORS}, pr AS (SELECT anchor_id, list_distance(base, qv) AS qd, qv FROM a, q ORDER BY qd, anchor_id LIMIT 3), cand AS (SELECT * FROM (SELECT n.vec_id, n.v, pr.qv, pr.qd, {{t}} AS t, row_number() OVER (PARTITION BY n.anchor_id ORDER BY {{t}}, n.vec_id) AS k2 FROM n JOIN pr USING (anchor_id)) WHERE k2 <= 20)"


def _anchor_query(spark: SparkSession, sf: str, **how) -> DataFrame:
    anchors = _anchors(spark, sf)
    held = [(r[0], list(r[1])) for r in anchors.collect()]
    return _out(search.anchor_search(search.assign_anchors(points(spark, sf), anchors), held, query_vector(spark, sf), 10, **how), "vec_id", "distance")


@_register(f"{_P} SELECT vec_id, round(list_distance(v, qv), 6) AS distance FROM p, q ORDER BY list_distance(v, qv), vec_id LIMIT 10")
def anchor_search_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The exact neighbours by the index, whose cells the triangle inequality rules out."""
    anchors = _anchors(spark, sf)
    held = [(r[0], list(r[1])) for r in anchors.collect()]
    return _out(search.anchor_knn(search.assign_anchors(points(spark, sf), anchors), held, query_vector(spark, sf), 10), "vec_id", "distance")


_RECALL = f"{_ANCHORS}, qs AS (SELECT vec_id AS query_id, v AS w FROM p WHERE vec_id % 20 = 0), tr AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(w, v), vec_id) AS r FROM qs, p) WHERE r <= 10), rk AS (SELECT query_id, anchor_id, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(w, base), anchor_id) AS probes FROM qs, a), h AS (SELECT probes, count(*) AS hits FROM tr JOIN n USING (vec_id) JOIN rk USING (query_id, anchor_id) GROUP BY probes), pr AS (SELECT probes, sum(coalesce(hits, 0)) OVER (ORDER BY probes) / (SELECT sum(hits) FROM h) AS recall FROM (SELECT DISTINCT probes FROM rk) LEFT JOIN h USING (probes))"


@_register(f"{_RECALL} SELECT probes::INT AS probes, round(recall, 6) AS recall FROM pr")
def anchor_probe_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the index against brute force by number of probes, over the rows whose id 20 divides."""
    p = points(spark, sf)
    return _out(search.probe_recall(p, _anchors(spark, sf), _queries_of(p)), "probes", "recall", rounded="recall")


@_register(f"{_RECALL} SELECT min(probes)::INT AS probes, round(min(recall), 6) AS recall FROM pr WHERE recall >= 0.9 - 1e-12")
def anchor_search_probes(spark: SparkSession, sf: str) -> DataFrame:
    """The number of probes to search with, by measured recall of at least 0.9."""
    measured = search.probe_recall(points(spark, sf), _anchors(spark, sf), _queries_of(points(spark, sf)))
    return _out(measured.where(F.col("probes") == search.probes_for(measured)), "probes", "recall", rounded="recall")


@_register(_PROBE.format(t=_TANGENT) + " SELECT vec_id, round(t + 0.5 * qd * qd, 6) AS distance FROM cand ORDER BY t + 0.5 * qd * qd, vec_id LIMIT 10")
def anchor_search_scored(spark: SparkSession, sf: str) -> DataFrame:
    return _anchor_query(spark, sf, scored=True, dim=DIM)


_ERR = f"{_ANCHORS}, e AS (SELECT vec_id, anchor_id, list_distance(v[33:64], base[33:64]) AS error FROM n)"


@_register(f"{_ERR} SELECT count(*) AS n, round(avg((error <= 0.9)::INT), 6) AS ratio, round(avg(error), 6) AS mean_error, round(max(error), 6) AS max_error, round(stddev_pop(error), 6) AS std_error FROM e")
def coverage_analysis(spark: SparkSession, sf: str) -> DataFrame:
    e = search.coverage(points(spark, sf), _anchors(spark, sf), 32, 0.9)
    out = e.agg(F.count("*").alias("n"), F.avg(F.col("covered").cast("int")).alias("ratio"), F.avg("error").alias("mean_error"), F.max("error").alias("max_error"), F.stddev_pop("error").alias("std_error"))
    return _out(out, "n", "ratio", "mean_error", "max_error", "std_error", rounded="ratio mean_error max_error std_error")


@_register(f"{_ERR} SELECT vec_id, round(error, 6) AS error FROM e WHERE error > 1.0")
def anomaly_residual(spark: SparkSession, sf: str) -> DataFrame:
    return _out(search.coverage(points(spark, sf), _anchors(spark, sf), 32, 1.0).where("not covered"), "vec_id", "error", rounded="error")


def _fps_sql(n: int) -> str:
    """Each round adds the point farthest from those chosen so far (ties: lowest id)."""
    parts = [f"{_P}, c0 AS (SELECT 0 AS ordinal, vec_id, v AS b FROM p WHERE vec_id = 0), m0 AS (SELECT p.vec_id, v, list_distance(v, b) AS g FROM p, c0)"]
    for k in range(1, n):
        parts.append(f"c{k} AS (SELECT {k} AS ordinal, vec_id, v AS b FROM m{k - 1} ORDER BY g DESC, vec_id LIMIT 1), m{k} AS (SELECT m.vec_id, v, least(g, list_distance(v, b)) AS g FROM m{k - 1} m, c{k})")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT ordinal::INT AS ordinal, vec_id, list_transform(b, lambda x: round(x, 6) + 0) AS base FROM c{k}" for k in range(n))


@_register(_fps_sql(8))
def fps_anchors(spark: SparkSession, sf: str) -> DataFrame:
    chosen = search.farthest_points(points(spark, sf), 8, 0)
    return spark.createDataFrame([(i, int(a), [round(x, 6) + 0.0 for x in v]) for i, (a, v) in enumerate(chosen)], "ordinal int, vec_id long, base array<double>")


@_register()
def pca_charts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(atlas.pca_atlas(points(spark, sf), "label", DIM, AMBIENT), atlas.CHARTS)


@_register()
def atlas_build(spark: SparkSession, sf: str) -> DataFrame:
    """k-means regions -> PCA charts -> located points, with each chart's size and mean residual."""
    regions = atlas.kmeans_labels(points(spark, sf), 4)
    charts = spark.createDataFrame(atlas.pca_atlas(regions, "cluster", DIM, AMBIENT), atlas.CHARTS)
    return atlas.locate(points(spark, sf), charts).groupBy("chart_id").agg(F.count("*").alias("n"), F.avg("residual").alias("mean_residual"))


@_register()
def auto_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(atlas.auto_transitions(atlas.pca_atlas(points(spark, sf), "label", DIM, AMBIENT)), atlas.TRANSITIONS)


@_register(f"{_CHARTS} SELECT a.chart_id AS a, b.chart_id AS b, round(1 / (1 + list_distance(a.o[9:64], b.o[9:64])), 6) AS score FROM c a JOIN c b ON a.chart_id < b.chart_id")
def chart_overlap_scores(spark: SparkSession, sf: str) -> DataFrame:
    charts = label_charts(spark, sf)
    return spark.createDataFrame([(a[0], b[0], round(atlas.overlap_score(a, b), 6)) for a in charts for b in charts if a[0] < b[0]], "a int, b int, score double")


@_register(f"{_P}, o AS (SELECT list(m ORDER BY i) AS o FROM (SELECT i, avg(v[i]) AS m FROM p, range(1, 65) t(i) GROUP BY i)), r AS (SELECT list_distance(v[9:64], o[9:64]) AS r FROM p, o) SELECT count(*) AS n, round(avg(r), 6) AS mean_residual, round(avg((r < 0.9)::INT), 6) AS share_below, 1.0::DOUBLE AS condition FROM r")
def chart_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Of the chart at the mean of all points along the first axes."""
    origin = points(spark, sf).agg(F.array(*[F.avg(F.get("vector", F.lit(i))) for i in range(AMBIENT)])).first()[0]
    chart = (0, list(origin), [[1.0 if j == i else 0.0 for j in range(AMBIENT)] for i in range(DIM)])
    return _out(atlas.chart_quality(points(spark, sf), chart, 0.9), "n", "mean_residual", "share_below", "condition", rounded="mean_residual share_below condition")


# Graph (G).

_GRAPH = f"{_P}, k AS (SELECT i, j, exp(-d) AS w FROM (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM p a JOIN p b ON a.vec_id <> b.vec_id) WHERE r <= 5), g AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, w FROM k UNION ALL SELECT j, i, w FROM k) GROUP BY i, j), o AS (SELECT DISTINCT x.label AS chart_a, y.label AS chart_b, i AS vec_id FROM g JOIN p x ON x.vec_id = i JOIN p y ON y.vec_id = j WHERE x.label <> y.label)"


@_register(f"{_GRAPH} SELECT i, j, round(w, 6) AS w FROM g")
def knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _out(atlas.knn_graph(points(spark, sf), 5), "i", "j", "w", rounded="w")


@_register(f"{_GRAPH} SELECT * FROM o")
def chart_overlap_points(spark: SparkSession, sf: str) -> DataFrame:
    return atlas.overlap_points(atlas.knn_graph(points(spark, sf), 5), points(spark, sf))


@_register(f"{_GRAPH} SELECT chart_a, chart_b, count(*) AS n, round(min(v[1]) - 0.05 * (max(v[1]) - min(v[1])), 6) AS lo, round(max(v[1]) + 0.05 * (max(v[1]) - min(v[1])), 6) AS hi FROM o JOIN p USING (vec_id) GROUP BY chart_a, chart_b")
def overlap_bounds(spark: SparkSession, sf: str) -> DataFrame:
    o = chart_overlap_points(spark, sf).join(points(spark, sf).select("vec_id", F.get("vector", F.lit(0)).alias("x")), "vec_id")
    lo, hi = F.min("x"), F.max("x")
    return o.groupBy("chart_a", "chart_b").agg(F.count("*").alias("n"), F.round(lo - 0.05 * (hi - lo), 6).alias("lo"), F.round(hi + 0.05 * (hi - lo), 6).alias("hi"))


@_register(f"{_GRAPH}, c AS (SELECT chart_a, chart_b, i, count(*) AS n, min(v[i]) AS lo, max(v[i]) AS hi FROM o JOIN p USING (vec_id), range(1, 9) t(i) GROUP BY chart_a, chart_b, i) SELECT chart_a, chart_b, max(n) AS n, list(round(lo - 0.05 * (hi - lo), 6) + 0 ORDER BY i) AS lo, list(round(hi + 0.05 * (hi - lo), 6) + 0 ORDER BY i) AS hi FROM c GROUP BY chart_a, chart_b")
def overlap_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The same over all local coordinates."""
    boxes = atlas.overlap_boxes(chart_overlap_points(spark, sf), points(spark, sf), DIM)
    return boxes.select("chart_a", "chart_b", "n", _neat("lo", 6), _neat("hi", 6))


@_register()
def graph_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Louvain over the points' k-NN graph (chart_id); community has those of under 3 points merged by centroid."""
    p = points(spark, sf)
    found = spectral.merge_small(p, spectral.louvain(atlas.knn_graph(p, 5)), 3)
    return found.select(F.col("id").alias("vec_id"), F.col("community").alias("chart_id"), F.col("merged").alias("community"))


_AFFINE = f"list_transform(range(1, 9), lambda i: round(v[i % 8 + 1] + {_list(SHIFT)}[i], 6) + 0)"


@_register(f"{_P} SELECT vec_id, {_AFFINE} AS moved FROM p")
def affine_transition_apply(spark: SparkSession, sf: str) -> DataFrame:
    moved = V.affine(V.matrix_literal(ROTATION), V.literal(SHIFT), _local())
    return points(spark, sf).select("vec_id", F.transform(moved, lambda x: F.round(x, 6)).alias("moved"))


@_register("SELECT kind, m::DOUBLE[][] AS matrix, b::DOUBLE[] AS bias FROM (VALUES ('affine', {0}, {1}), ('rotation', {2}, {3})) t(kind, m, b)".format(_list(ROTATION), _list(SHIFT), _list(PROPER), _list(SHIFT)))
def affine_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Recovers an affine map from pairs, and the best rotation from pairs that one moved."""
    def moved(matrix):
        return points(spark, sf).select(_local().alias("x"), V.affine(V.matrix_literal(matrix), V.literal(SHIFT), _local()).alias("y"))

    fits = (("affine", *atlas.affine_fit(moved(ROTATION), DIM)), ("rotation", *atlas.procrustes_fit(moved(PROPER), DIM)))
    return spark.createDataFrame([(kind, (np.round(m, 6) + 0.0).tolist(), (np.round(b, 6) + 0.0).tolist()) for kind, m, b in fits], "kind string, matrix array<array<double>>, bias array<double>")


_EDGE_SQL = ", ".join(f"({a}, {b})" for a, b in EDGES)


@_register(f"WITH RECURSIVE e AS (SELECT * FROM (VALUES {_EDGE_SQL}) t(s, d)), u AS (SELECT s, d FROM e UNION SELECT d, s FROM e), r AS (SELECT 0 AS chart, 0 AS hops UNION SELECT u.d, r.hops + 1 FROM r JOIN u ON u.s = r.chart WHERE r.hops < 10) SELECT chart, min(hops)::INT AS hops FROM r GROUP BY chart")
def chart_path_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return atlas.chart_paths(spark.createDataFrame(list(EDGES), "src int, tgt int"), 0, spark)


def _steps() -> list[tuple]:
    return [(i, i + 1, [list(map(float, r)) for r in ROTATION], [x * (i + 1) for x in SHIFT]) for i in range(3)]


@_register(f"{_P}, t AS (SELECT vec_id, v[1:8] AS x FROM p), h1 AS (SELECT vec_id, list_transform(range(1, 9), lambda i: x[i % 8 + 1] + {_list(SHIFT)}[i]) AS x FROM t), h2 AS (SELECT vec_id, list_transform(range(1, 9), lambda i: x[i % 8 + 1] + 2 * {_list(SHIFT)}[i]) AS x FROM h1) SELECT vec_id, list_transform(range(1, 9), lambda i: round(x[i % 8 + 1] + 3 * {_list(SHIFT)}[i], 6)) AS moved FROM h2")
def transport_chain(spark: SparkSession, sf: str) -> DataFrame:
    steps = _steps()
    moved = atlas.carried(_local(), steps, atlas.shortest_chain(steps, 0, 3))
    return points(spark, sf).select("vec_id", F.transform(moved, lambda x: _half_away(x, 6)).alias("moved"))


@_register(f"{_P}, t AS (SELECT v[1:8] AS x FROM p) SELECT k::INT AS src, (k + 1)::INT AS tgt, round(avg(list_distance(x, list_transform(range(1, 9), lambda i: x[i % 8 + 1] + (k + 1) * {_list(SHIFT)}[i]))), 6) AS cost FROM t, range(0, 3) s(k) GROUP BY k")
def transport_cost_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    local = points(spark, sf).select(_local().alias("vector"))
    return _out(atlas.transport_costs(local, spark.createDataFrame(_steps(), atlas.TRANSITIONS)), "src", "tgt", "cost", rounded="cost")


@_register("SELECT a, b, c, round(e, 6) AS error FROM (VALUES (0, 1, 2, 0.3), (0, 1, 3, 0.4), (0, 2, 3, {0}), (1, 2, 3, 0.0)) t(a, b, c, e)".format((0.3**2 + 0.4**2) ** 0.5))
def cocycle_check(spark: SparkSession, sf: str) -> DataFrame:
    """Composed transitions of which two direct ones are off by 0.3 and 0.4 along axes that the last map keeps apart."""
    steps, more = _steps(), []
    for a, b, axis, off in ((0, 2, 1, 0.3), (1, 3, 0, 0.0), (0, 3, 4, 0.4)):
        matrix, bias = atlas.compose(steps, list(range(a, b + 1)))
        more.append((a, b, matrix.tolist(), (bias + off * np.eye(DIM)[axis]).tolist()))
    found = atlas.cocycle_errors(spark.createDataFrame(steps + more, atlas.TRANSITIONS))
    return found.select("a", "b", "c", F.round("error", 6).alias("error"))


# Metrics (M).

_RBF = f"{_P}, a AS (SELECT vec_id AS anchor_no, v[1:8] AS coords, list_transform(v[1:8], lambda x: 1 + x * x) AS g FROM p WHERE vec_id % {_STEP_SQL} = 0), c AS (SELECT vec_id, g, exp(-0.5 * (r / 0.5) ** 2) AS w FROM (SELECT p.vec_id, g, list_distance(v[1:8], coords) AS r, row_number() OVER (PARTITION BY p.vec_id ORDER BY list_distance(v[1:8], coords), anchor_no) AS k FROM p, a) WHERE k <= 5), m AS (SELECT vec_id, i, sum(w * g[i]) / sum(w) AS x FROM c, range(1, 9) t(i) GROUP BY vec_id, i)"


@_register(f"{_RBF} SELECT vec_id, list(round(x, 6) ORDER BY i) AS g FROM m GROUP BY vec_id")
def rbf_metric_eval(spark: SparkSession, sf: str) -> DataFrame:
    local = points(spark, sf).select("vec_id", _local().alias("vector"))
    anchors = _sampled(local).select(F.col("vec_id").alias("anchor_no"), F.col("vector").alias("coords"), F.transform("vector", lambda x: 1.0 + x * x).alias("g"), F.lit(1.0).alias("weight"), F.lit(0.5).alias("sigma"))
    return metrics.rbf_metric(local, anchors).select("vec_id", F.transform("g", lambda x: F.round(x, 6)).alias("g"))


@_register(f"{_P}, r AS (SELECT vec_id, list_distance(v, qv) / 0.7 AS s FROM p, q) SELECT vec_id, round(exp(-0.5 * s * s), 6) AS gaussian, round(CASE WHEN s > 0 THEN s * s * ln(s) ELSE 0 END, 6) AS thin_plate, round(1 / (1 + s * s), 6) AS inverse_quadratic FROM r")
def rbf_kernels(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.with_distance(points(spark, sf), V.literal(query_vector(spark, sf)))
    r, s = F.col("distance"), F.lit(0.7)
    return rows.select("vec_id", *[F.round(f(r, s), 6).alias(f.__name__) for f in (metrics.gaussian, metrics.thin_plate, metrics.inverse_quadratic)])


@_register(f"{_P}, w AS (SELECT vec_id, list_transform(v[1:8], lambda x: 0.5 + abs(x)) AS w FROM p) SELECT vec_id, round(exp(list_sum(list_transform(w, lambda x: ln(x)))), 8) AS det, round(list_sum(list_transform(w, lambda x: ln(x))), 6) AS logdet, round(sqrt(exp(list_sum(list_transform(w, lambda x: ln(x))))), 6) AS volume, round(1 / w[1], 6) AS first_inverse FROM w")
def diag_metric_det(spark: SparkSession, sf: str) -> DataFrame:
    inverse, det, logdet, volume = metrics.diagonal_terms(F.transform(_local(), lambda x: 0.5 + F.abs(x)))
    return points(spark, sf).select("vec_id", F.round(det, 8).alias("det"), F.round(logdet, 6).alias("logdet"), F.round(volume, 6).alias("volume"), F.round(F.get(inverse, F.lit(0)), 6).alias("first_inverse"))


@_register(f"{_P} SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, round(avg(v[i] * v[j]), 8) AS value FROM p, range(1, 9) a(i), range(1, 9) b(j) GROUP BY a.i, b.j")
def score_outer_product(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.score_outer(points(spark, sf), DIM).select("i", "j", F.round("value", 8).alias("value"))


@_register(f"{_P} SELECT vec_id, round(CASE WHEN list_distance(v, qv) < 1e-12 THEN 1 ELSE least(100, greatest(0.01, {_CONFORMAL} / list_distance(v, qv))) END, 6) AS factor FROM p, q")
def conformal_factor(spark: SparkSession, sf: str) -> DataFrame:
    q = V.literal(query_vector(spark, sf))
    return points(spark, sf).select("vec_id", F.round(metrics.conformal_factor(V.conformal(F.col("vector"), q), V.euclidean(F.col("vector"), q)), 6).alias("factor"))


@_register(f"{_P}, m AS (SELECT label, i, avg(v[i]) AS mu, stddev_pop(v[i]) AS sd FROM p, range(1, 9) t(i) GROUP BY label, i) SELECT label, list(round(mu, 6) ORDER BY i) AS mean, list(round(sd, 6) ORDER BY i) AS deviation FROM m GROUP BY label")
def label_moments(spark: SparkSession, sf: str) -> DataFrame:
    cell = [F.get("vector", F.lit(i)) for i in range(DIM)]
    return points(spark, sf).groupBy("label").agg(F.array(*[F.round(F.avg(c), 6) for c in cell]).alias("mean"), F.array(*[F.round(F.stddev_pop(c), 6) for c in cell]).alias("deviation"))


@_register(f"{_P}, m AS (SELECT i, avg(v[i]) AS mu, stddev_pop(v[i]) AS sd FROM p, range(1, 9) t(i) GROUP BY i), l AS (SELECT list(mu ORDER BY i) AS mu, list(sd ORDER BY i) AS sd FROM m) SELECT vec_id, list_transform(range(1, 9), lambda i: round((v[i] - mu[i]) / sd[i], 5)) AS scaled FROM p, l")
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    local = points(spark, sf).select("vec_id", _local().alias("vector"))
    return atlas.standardised(local, DIM).select("vec_id", F.transform("vector", lambda x: F.round(x, 5)).alias("scaled"))


@_register(f"{_P}, m AS (SELECT 1 + v[1] AS a, v[2] AS b, 0.05 + v[3] AS c FROM p), e AS (SELECT (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS lo, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS hi FROM m) SELECT count(*) AS n, count(*) FILTER (lo > 0) AS n_spd, round(max(hi / lo) FILTER (lo > 0), 3) AS condition FROM e")
def spd_report(spark: SparkSession, sf: str) -> DataFrame:
    cell = [F.get("vector", F.lit(i)) for i in range(3)]
    rows = points(spark, sf).select(F.array(1 + cell[0], cell[1], cell[1], 0.05 + cell[2]).alias("g"))
    return metrics.spd_report(rows, 2).select("n", F.col("n_spd").cast("long").alias("n_spd"), F.round("condition", 3).alias("condition"))


# Paths and transport (E, P).

_ENDS = f"{_P}, e AS (SELECT a.vec_id AS path_id, a.v[1:8] AS a, b.v[1:8] AS b FROM p a JOIN p b ON b.vec_id = a.vec_id + 1), w AS (SELECT path_id, s AS step, list_transform(range(1, 9), lambda i: a[i] + (b[i] - a[i]) * (s / 20.0::DOUBLE) ** {{power}}) AS x, a, b FROM e, range(0, 21) t(s))"


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    rows = _following(points(spark, sf).select("vec_id", _local().alias("vector")))
    return rows.select(F.col("i").alias("path_id"), "a", "b")


@_register(_ENDS.format(power=1) + " SELECT path_id, step::INT AS step, list_transform(x, lambda c: round(c, 6) + 0) AS point, round(list_distance(a, b) * step / 20, 6) AS arc_length FROM w")
def geodesic_path_flat(spark: SparkSession, sf: str) -> DataFrame:
    rows = paths.straight_paths(_ends(spark, sf))
    return rows.select("path_id", "step", F.transform("point", lambda c: F.round(c, 6)).alias("point"), F.round("arc_length", 6).alias("arc_length"))


def _bent(spark: SparkSession, sf: str) -> DataFrame:
    """Paths whose first four coordinates run ahead, so that they turn and are unevenly spaced."""
    rows = _ends(spark, sf).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(20))))
    t = F.col("step") / 20.0
    x = F.zip_with(F.col("a"), F.col("b"), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    point = F.transform(x, lambda c, i: c["p"] + (c["q"] - c["p"]) * F.when(i < 4, t * t).otherwise(t))
    return rows.select("path_id", "step", point.alias("point"))


_BENT = _ENDS.format(power="(CASE WHEN i <= 4 THEN 2 ELSE 1 END)") + ", z AS (SELECT *, lag(x) OVER o AS x0, lead(x) OVER o AS x1 FROM w WINDOW o AS (PARTITION BY path_id ORDER BY step))"


@_register(f"{_BENT}, s AS (SELECT path_id, list_distance(x, x0) AS l FROM z WHERE x0 IS NOT NULL) SELECT path_id, round(sum(l), 6) AS length, round(0.5 * sum(l * l) * 20, 6) AS energy FROM s GROUP BY path_id")
def path_energy(spark: SparkSession, sf: str) -> DataFrame:
    return _out(paths.energy(_bent(spark, sf)), "path_id", "length", "energy", rounded="length energy")


@_register(f"{_BENT} SELECT path_id, step::INT AS step, round(sqrt(list_sum(list_transform(range(1, 9), lambda i: ((x1[i] - x[i]) / list_distance(x1, x) - (x[i] - x0[i]) / list_distance(x, x0)) ** 2))) / ((list_distance(x1, x) + list_distance(x, x0)) / 2), 4) AS curvature FROM z WHERE x0 IS NOT NULL AND x1 IS NOT NULL")
def path_curvature(spark: SparkSession, sf: str) -> DataFrame:
    rows = paths.curvature(_bent(spark, sf))
    return rows.select("path_id", "step", F.round("curvature", 4).alias("curvature"))


@_register(f"""{_BENT}, s AS (SELECT path_id, step, x0, x, list_distance(x, x0) AS l FROM z WHERE x0 IS NOT NULL),
c AS (SELECT *, sum(l) OVER (PARTITION BY path_id ORDER BY step) AS upto, sum(l) OVER (PARTITION BY path_id) AS total FROM s),
k AS (SELECT path_id, n AS step, x0, x, least(1, greatest(0, (n * total / 10 - (upto - l)) / l)) AS t, row_number() OVER (PARTITION BY path_id, n ORDER BY c.step) AS r FROM c, range(0, 11) g(n) WHERE n * total / 10 <= upto + 1e-9 * total / 10)
SELECT path_id, step::INT AS step, list_transform(range(1, 9), lambda i: round(x0[i] + (x[i] - x0[i]) * t, 5) + 0) AS point FROM k WHERE r = 1""")
def resample_path(spark: SparkSession, sf: str) -> DataFrame:
    rows = paths.resample(_bent(spark, sf), 10)
    return rows.select("path_id", "step", F.transform("point", lambda c: F.round(c, 5)).alias("point"))


@_register(f"{_P} SELECT vec_id, list_transform(range(1, 9), lambda i: round(v[i] + 0.5 * qv[i], 6) + 0) AS exp_point, list_transform(range(1, 9), lambda i: round((qv[i] - v[i]) / {_list(DIAGONAL)}[i], 6) + 0) AS log_vector FROM p, q")
def retraction(spark: SparkSession, sf: str) -> DataFrame:
    q = V.literal(query_vector(spark, sf)[:DIM])
    out, back = paths.retract(_local(), V.scaled(q, F.lit(0.5))), paths.inverse_retract(_local(), q, V.literal(DIAGONAL[:DIM]))
    return points(spark, sf).select("vec_id", F.transform(out, lambda x: F.round(x, 6)).alias("exp_point"), F.transform(back, lambda x: F.round(x, 6)).alias("log_vector"))


def _sphere_points(spark: SparkSession, sf: str) -> DataFrame:
    """(id, a, b): pairs of (polar angle, azimuth) away from the poles, from the first coordinates."""
    x = [F.get("vector", F.lit(i)) for i in range(4)]
    return points(spark, sf).select("vec_id", F.array(1.2 + x[0], x[1]).alias("a"), F.array(1.6 + x[2], 0.8 + x[3]).alias("b"))


_SPHERE = f"{_P}, e AS (SELECT vec_id, 1.2 + v[1] AS t1, v[2] AS f1, 1.6 + v[3] AS t2, 0.8 + v[4] AS f2 FROM p), arc AS (SELECT *, acos(greatest(-1, least(1, cos(t1) * cos(t2) + sin(t1) * sin(t2) * cos(f1 - f2)))) AS d FROM e)"
_SHOT = f"{_SPHERE}, s AS (SELECT vec_id, sqrt(0.09 + 0.16 * sin(t1) ** 2) AS s, sin(t1) * cos(f1) AS x, sin(t1) * sin(f1) AS y, cos(t1) AS z, 0.3 * cos(t1) * cos(f1) - 0.4 * sin(t1) * sin(f1) AS ux, 0.3 * cos(t1) * sin(f1) + 0.4 * sin(t1) * cos(f1) AS uy, -0.3 * sin(t1) AS uz FROM e), n AS (SELECT vec_id, s, cos(s) * x + sin(s) / s * ux AS x, cos(s) * y + sin(s) / s * uy AS y, cos(s) * z + sin(s) / s * uz AS z FROM s)"


@_register(f"{_SHOT} SELECT vec_id, [round(acos(z), 5) + 0, round(atan2(y, x), 5) + 0] AS end FROM n")
def ivp_rk4_sphere(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sphere_points(spark, sf).select("vec_id", udfs.exp_map("sphere", F.col("a"), F.array(F.lit(0.3), F.lit(0.4)), 200).alias("end"))
    return rows.select("vec_id", _neat("end", 5))


@_register(f"{_SPHERE}, m AS (SELECT *, sqrt((t2 - t1) ** 2 + sin((t1 + t2) / 2) ** 2 * (f2 - f1) ** 2) AS l FROM arc) SELECT vec_id, round(d, 5) AS distance, round(d, 5) AS great_circle, round(l * greatest(0.5, 1 - l * l / 12), 4) AS corrected FROM m")
def bvp_sphere_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Next to it the great-circle distance, which it must equal, and the straight length corrected for curvature."""
    a, b = F.col("a"), F.col("b")
    arc = F.acos(F.cos(a[0]) * F.cos(b[0]) + F.sin(a[0]) * F.sin(b[0]) * F.cos(a[1] - b[1]))
    rows = _sphere_points(spark, sf).select("vec_id", udfs.geodesic_distance("sphere", a, b).alias("distance"), arc.alias("great_circle"), udfs.curvature_corrected("sphere", a, b).alias("corrected"))
    return rows.select("vec_id", F.round("distance", 5).alias("distance"), F.round("great_circle", 5).alias("great_circle"), F.round("corrected", 4).alias("corrected"))


@_register(f"{_SPHERE} SELECT vec_id, list_transform([0, 0, 0, -sin(t1) * cos(t1), 0, cos(t1) / sin(t1), cos(t1) / sin(t1), 0], lambda x: round(x, 5) + 0) AS gamma FROM e")
def christoffel_sphere(spark: SparkSession, sf: str) -> DataFrame:
    return _sphere_points(spark, sf).select("vec_id", udfs.christoffel("sphere", F.col("a")).alias("gamma")).select("vec_id", _neat("gamma", 5))


@_register(f"{_P} SELECT vec_id, 2.0::DOUBLE AS scalar FROM p")
def scalar_curvature_sphere(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded to what differences of differences hold."""
    return _sphere_points(spark, sf).select("vec_id", F.round(udfs.scalar_curvature("sphere", F.col("a")), 2).alias("scalar"))


@_register(f"{_P}, h AS (SELECT vec_id, v[1] AS x1, 1 + abs(v[2]) AS y1, v[3] AS x2, 1 + abs(v[4]) AS y2 FROM p), c AS (SELECT *, (x2 * x2 + y2 * y2 - x1 * x1 - y1 * y1) / (2 * (x2 - x1)) AS c, acosh(1 + ((x2 - x1) ** 2 + (y2 - y1) ** 2) / (2 * y1 * y2)) AS d FROM h WHERE x1 <> x2) SELECT vec_id, list_transform([y1, c - x1], lambda t: round(t * d * y1 * sign(x2 - x1) / sqrt((x1 - c) ** 2 + y1 * y1), 5) + 0) AS velocity FROM c")
def log_map_half_plane(spark: SparkSession, sf: str) -> DataFrame:
    x = [F.get("vector", F.lit(i)) for i in range(4)]
    rows = points(spark, sf).select("vec_id", F.array(x[0], 1.0 + F.abs(x[1])).alias("a"), F.array(x[2], 1.0 + F.abs(x[3])).alias("b"))
    return rows.select("vec_id", udfs.log_map("half_plane", F.col("a"), F.col("b")).alias("velocity")).select("vec_id", _neat("velocity", 5))


def _slope(v0: str, v1: str, share: str) -> str:
    """dv/dt of a vector carried along the straight coordinate line, with the sphere's Christoffel symbols in closed form."""
    angle = f"(t1 + (n + {share}) / 32.0::DOUBLE * dt)"
    return f"sin{angle} * cos{angle} * df * {v1}, -cos{angle} / sin{angle} * (dt * {v1} + df * {v0})"


def _carried_sql() -> str:
    inner = "SELECT * FROM r WHERE n < 32"
    for k, (share, step) in enumerate((("0", None), ("0.5", 1 / 64), ("0.5", 1 / 64), ("1", 1 / 32)), 1):
        v0, v1 = ("v0", "v1") if step is None else (f"(v0 + {step!r} * k{k - 1}[1])", f"(v1 + {step!r} * k{k - 1}[2])")
        inner = f"SELECT *, [{_slope(v0, v1, share)}] AS k{k} FROM ({inner})"
    new = [f"v{c} + (k1[{c + 1}] + 2 * k2[{c + 1}] + 2 * k3[{c + 1}] + k4[{c + 1}]) / 192.0::DOUBLE" for c in (0, 1)]
    start = _SPHERE.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{start}, r AS (SELECT vec_id, 0 AS n, t1, t2 - t1 AS dt, f2 - f1 AS df, 1.0::DOUBLE AS v0, 0.0::DOUBLE AS v1 FROM e UNION ALL SELECT vec_id, n + 1, t1, dt, df, {new[0]}, {new[1]} FROM ({inner})) SELECT vec_id, [round(v0, 5) + 0, round(v1, 5) + 0] AS vector FROM r WHERE n = 32"


_CARRIED = _carried_sql()


@_register(_CARRIED)
def parallel_transport_sphere(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sphere_points(spark, sf).select("vec_id", udfs.transported("sphere", F.col("a"), F.col("b"), F.array(F.lit(1.0), F.lit(0.0))).alias("vector"))
    return rows.select("vec_id", _neat("vector", 5))


@_register("WITH g AS (SELECT a.i / 4.0::DOUBLE AS x, b.i / 4.0::DOUBLE AS y FROM range(-4, 5) a(i), range(-4, 5) b(i)), u AS (SELECT x, y, x * x + y * y AS u FROM g), f AS (SELECT *, 1 + 8 * u * (u - 1) ** 2 AS f, 8 * (u - 1) * (3 * u - 1) AS f1, 8 * (6 * u - 4) AS f2 FROM u) SELECT x, y, round(-4 / f * (f1 / f + u * (f2 / f - (f1 / f) ** 2)), 2) + 0 AS scalar FROM f")
def curvature_field(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar curvature on a grid of the wells metric."""
    axis = F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda i: i / 4.0))
    grid = spark.range(1).select(axis.alias("x")).select("x", axis.alias("y"))
    return grid.select("x", "y", (F.round(udfs.scalar_curvature("wells", F.array("x", "y")), 2) + F.lit(0.0)).alias("scalar"))


@_register(f"{_P} SELECT vec_id, list_concat(v[1:8], [0.0, 0.0]) AS vector FROM (SELECT vec_id, list_transform(v, lambda x: round(x, 6) + 0) AS v FROM p)")
def schema_transport_pad(spark: SparkSession, sf: str) -> DataFrame:
    moved = paths.schema_transport(_local(), DIM, DIM + 2)
    return points(spark, sf).select("vec_id", F.transform(moved, lambda x: F.round(x, 6)).alias("vector"))


@_register(f"{_P} SELECT vec_id, list_transform(v[1:5], lambda x: round(x, 6) + 0) AS vector FROM p")
def schema_transport_truncate(spark: SparkSession, sf: str) -> DataFrame:
    moved = paths.schema_transport(_local(), DIM, 5)
    return points(spark, sf).select("vec_id", F.transform(moved, lambda x: F.round(x, 6)).alias("vector"))


_DRIFT = f"{_P}, m AS (SELECT vec_id // 50 AS time_step, i, avg(v[i]) AS c FROM p, range(1, 9) t(i) GROUP BY 1, 2), c AS (SELECT time_step, list(c ORDER BY i) AS c FROM m GROUP BY time_step)"


@_register(f"{_DRIFT} SELECT time_step, round(coalesce(list_distance(c, lag(c) OVER (ORDER BY time_step)), 0), 6) AS drift FROM c")
def temporal_centroid_drift(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).withColumn("time_step", F.floor(F.col("vec_id") / 50))
    return _out(paths.centroid_drift(rows, "time_step", "vector", DIM), "time_step", "drift", rounded="drift")


# Store (I), diagnostics (A).


@_register("SELECT label AS modality, vec_id % 3 AS chart, count(*) AS n, grouping(label, vec_id % 3)::BIGINT AS level FROM embeddings GROUP BY CUBE (label, vec_id % 3)")
def stats_by_modality_chart(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("modality"), (F.col("vec_id") % 3).alias("chart"))
    return store.stats(rows, "modality", "chart")


@_register("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = store.latest(table(spark, sf, "events"), [F.desc("ts"), F.desc("event_id")], "user_id")
    return rows.select("user_id", "event_id", "event_type")


@_register("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0)")
def delete_anti(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    return store.delete(rows, rows.where("vec_id % 7 = 0"))


@_register("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 99 ELSE label END::INT AS label FROM embeddings")
def update_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    return store.update(rows, rows.where("vec_id % 4 = 0").select("vec_id", F.lit(99).alias("label")))


@_register("SELECT (SELECT x FROM (VALUES (0, 3), (1, 1), (2, 2)) t(x, y) WHERE y = vec_id)::INT AS ordinal, vec_id, label FROM embeddings WHERE vec_id IN (1, 2, 3)")
def get_batch(spark: SparkSession, sf: str) -> DataFrame:
    return store.get_batch(table(spark, sf, "embeddings").select("vec_id", "label"), [3, 1, 2, -5])


@_register(f"{_P} SELECT vec_id, label, list_transform(v, lambda x: round(x, 6) + 0) AS vector FROM p")
def export_import_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path, schema = f"{lineage.shared_folder(spark)}/export-{uuid.uuid4().hex}", "vec_id long, label int, vector array<double>"
    files.export(points(spark, sf), f"{path}/csv", "csv")
    files.export(files.load(spark, f"{path}/csv", schema, "csv"), f"{path}/json", "json")
    rows = files.load(spark, f"{path}/json", schema, "json")
    return rows.select("vec_id", "label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


_NN = f"{_P}, n AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS j, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM p a JOIN p b ON a.vec_id <> b.vec_id) WHERE r <= 10)"


@_register(f"{_NN}, t AS (SELECT q, max(CASE WHEN r = 1 THEN d END) AS r1, max(CASE WHEN r = 2 THEN d END) AS r2 FROM n GROUP BY q) SELECT round(1 / avg(ln(r2 / r1)), 4) AS dim FROM t WHERE r1 > 0")
def intrinsic_dim_twonn(spark: SparkSession, sf: str) -> DataFrame:
    return learning.dim_two_nn(learning.neighbour_distances(points(spark, sf), 2)).select(F.round("dim", 4).alias("dim"))


@_register(f"{_NN} SELECT round(1 / avg(ln(k.d / n.d)), 4) AS dim FROM n JOIN n k ON k.q = n.q AND k.r = 10 WHERE n.r < 10 AND n.d > 0")
def intrinsic_dim_mle(spark: SparkSession, sf: str) -> DataFrame:
    return learning.dim_mle(learning.neighbour_distances(points(spark, sf), 10), 10).select(F.round("dim", 4).alias("dim"))


@_register(f"{_NN} SELECT count(*) AS n, round(avg(d), 6) AS mean_d, round(quantile_cont(d, 0.5), 6) AS median_d, round(stddev_pop(d), 6) AS std_d FROM n WHERE r = 1")
def nn_distance_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _out(learning.nn_statistics(learning.neighbour_distances(points(spark, sf), 1)), "n", "mean_d", "median_d", "std_d", rounded="mean_d median_d std_d")


_RADII_SQL = ", ".join(f"({r})" for r in RADII)


@_register(f"{_P}, d AS (SELECT list_distance(a.v, b.v) AS d FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), c AS (SELECT r, avg((d < r)::INT) AS c FROM d, (VALUES {_RADII_SQL}) t(r) GROUP BY r) SELECT round(regr_slope(ln(c), ln(r::DOUBLE)), 4) AS dim FROM c WHERE c > 0")
def correlation_dimension(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    distances = search.batch_distances(p, _queries_of(p)).where("query_id <> vec_id")
    return learning.correlation_dimension(distances, list(RADII)).select(F.round("dim", 4).alias("dim"))


@_register("WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), s AS (SELECT k AS patch FROM n, range(0, 100000) t(k) WHERE k * 15 + 30 <= n) SELECT patch::INT AS patch, vec_id AS idx FROM embeddings JOIN s ON vec_id >= patch * 15 AND vec_id < patch * 15 + 30")
def sliding_patches(spark: SparkSession, sf: str) -> DataFrame:
    return learning.patches(table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx")), 30, 0.5)


@_register(f"{_P}{_BATCH}, t AS (SELECT query_id, vec_id FROM r WHERE rank <= 10), f AS (SELECT query_id, vec_id FROM (SELECT a.vec_id AS query_id, p.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v[1:32], p.v[1:32]), p.vec_id) AS k FROM p a, p WHERE a.vec_id % 20 = 0) WHERE k <= 10) SELECT t.query_id, count(f.vec_id) AS hits, round(count(f.vec_id) / 10.0::DOUBLE, 6) AS recall FROM t LEFT JOIN f USING (query_id, vec_id) GROUP BY t.query_id")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    half = p.select("vec_id", _local(32).alias("vector"))
    out = search.recall(search.knn_batch(half, _queries_of(half), 10), search.knn_batch(p, _queries_of(p), 10))
    return _out(out, "query_id", "hits", "recall", rounded="recall")


@_register(f"{_P} SELECT round(avg((m.label = o.label)::INT), 6) AS accuracy FROM (SELECT query_id, vec_id FROM (SELECT a.vec_id AS query_id, p.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, p.v), p.vec_id) AS k FROM p a, p WHERE a.vec_id % 20 = 0) WHERE k <= 5) x JOIN p m ON m.vec_id = x.query_id JOIN p o ON o.vec_id = x.vec_id")
def retrieval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    labels = p.select("vec_id", "label")
    rows = search.knn_batch(p, _queries_of(p), 5).join(labels, "vec_id").join(labels.toDF("query_id", "want"), "query_id")
    return rows.agg(F.round(F.avg((F.col("label") == F.col("want")).cast("int")), 6).alias("accuracy"))


@_register("WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(max(CASE WHEN r = least(floor(c * 0.95), c - 1) THEN value END), 6) AS p95, round(min(value), 6) AS least, round(max(value), 6) AS most, round(count(*) / sum(value), 8) AS rate FROM n GROUP BY event_type")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = learning.latency_summary(table(spark, sf, "events"), "event_type", "value")
    return s.select("event_type", "n", F.round("total", 4).alias("total"), *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "least", "most")], F.round("rate", 8).alias("rate"))


@_register("SELECT label AS modality, min(vec_id) AS first_id, count(*) AS n FROM embeddings GROUP BY label")
def modality_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("modality")).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))


@_register(f"{_P}, n AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS j, b.v, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM p a JOIN p b ON a.vec_id <> b.vec_id) WHERE r <= 20), m AS (SELECT q, list(x ORDER BY i) AS m FROM (SELECT q, i, avg(v[i]) AS x FROM n, range(1, 65) t(i) GROUP BY q, i) GROUP BY q), c AS (SELECT q, j, list_transform(range(1, 65), lambda i: v[i] - m[i]) AS x FROM n JOIN m USING (q)), g AS (SELECT a.q, sum(CASE WHEN a.j = b.j THEN list_dot_product(a.x, b.x) ELSE 0 END) / 20 AS total, sum(list_dot_product(a.x, b.x) ** 2) / 400 AS squares FROM c a JOIN c b ON a.q = b.q GROUP BY a.q) SELECT q AS query_id, list_transform(m[1:8], lambda x: round(x, 6) + 0) AS mean, round(total, 6) AS total, round(squares, 6) AS squares FROM g JOIN m USING (q)")
def local_pca(spark: SparkSession, sf: str) -> DataFrame:
    """Of the spectra their sum and sum of squares, which are the covariance's trace and squared norm."""
    e = F.col("eigenvalues")
    rows = learning.local_pca(points(spark, sf)).withColumn("mean", F.slice("mean", 1, DIM))
    return rows.select("query_id", _neat("mean", 6), F.round(V.total(e), 6).alias("total"), F.round(V.dot(e, e), 6).alias("squares"))


@_register()
def intrinsic_dim_pca(spark: SparkSession, sf: str) -> DataFrame:
    return learning.dim_local_pca(learning.local_pca(points(spark, sf)))


@_register()
def diffusion_map(spark: SparkSession, sf: str) -> DataFrame:
    """Diffusion coordinates of every point in the k-NN graph."""
    return spectral.diffusion_coordinates(atlas.knn_graph(points(spark, sf), 5)).select(F.col("id").alias("vec_id"), "coordinates")


@_register()
def tangent_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors carried between the tangent spaces of two PCA charts by the closest rotation."""
    a, b = atlas.pca_atlas(points(spark, sf).where("label < 2"), "label", DIM, AMBIENT)
    r = G.tangent_rotation(np.array(a[2]), np.array(b[2]))
    return points(spark, sf).select("vec_id", V.matvec(V.matrix_literal(r), _local()).alias("moved"))


@_register("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming aggregate, on the table as a batch."""
    from ..streaming import streams

    rows = streams.windowed_counts(table(spark, sf, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# Tangent spaces, boxes and samples (T, S12, S19, E5).


def _spaces(spark: SparkSession, sf: str) -> list[tuple]:
    assigned = points(spark, sf).select(F.col("label").cast("long").alias("anchor_id"), "vector")
    return tangent.tangent_spaces(assigned, {c[0]: c[1] for c in label_charts(spark, sf)}, AMBIENT, DIM)


@_register()
def tangent_spaces(spark: SparkSession, sf: str) -> DataFrame:
    """One space per label, at its mean."""
    return spark.createDataFrame(_spaces(spark, sf), tangent.SPACES)


@_register()
def tangent_carried(spark: SparkSession, sf: str) -> DataFrame:
    """Every point's coordinates in its label's space, carried to the next label's space."""
    spaces = _spaces(spark, sf)
    turns = [(a[0], a[1], a[2], G.tangent_rotation(np.array(a[2]), np.array(b[2])).tolist()) for a, b in zip(spaces, spaces[1:] + spaces[:1], strict=True)]
    side = F.broadcast(spark.createDataFrame(turns, "label int, base array<double>, basis array<array<double>>, turn array<array<double>>"))
    local = tangent.log_at(F.col("vector"), F.col("base"), F.col("basis"), AMBIENT)
    return points(spark, sf).join(side, "label").select("vec_id", V.matvec(F.col("turn"), local).alias("moved"))


_SHORT = "greatest(0.5, 1 - list_distance(v, o) ** 2 / (24.0 * 65))"


@_register(f"{_CHARTS} SELECT vec_id, list_transform(range(1, 9), lambda i: round((v[i] - o[i]) * {_SHORT}, 6) + 0) AS local FROM p JOIN c ON chart_id = label")
def tangent_log(spark: SparkSession, sf: str) -> DataFrame:
    charts = spark.createDataFrame(label_charts(spark, sf), atlas.CHARTS).withColumnRenamed("chart_id", "label")
    local = tangent.log_at(F.col("vector"), F.col("origin"), F.col("basis"), AMBIENT)
    return points(spark, sf).join(F.broadcast(charts), "label").select("vec_id", F.transform(local, lambda x: F.round(x, 6)).alias("local"))


@_register(f"{_P} SELECT vec_id, round(list_distance(v, qv), 6) AS distance FROM p, q WHERE list_distance(v, qv) <= 1.25")
def ball_pruned_by_boxes(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    found = tangent.pruned_ball(p, atlas.bounds(p, "label", AMBIENT), query_vector(spark, sf), 1.25, "label")
    return _out(found, "vec_id", "distance")


@_register(f"{_P} SELECT vec_id, CASE WHEN list_distance(v, qv) <= 1e-15 THEN 1.0::DOUBLE ELSE round({_CONFORMAL} / list_distance(v, qv), 6) END AS ratio FROM p, q")
def distance_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Distance under the conformal metric over the straight one, to the query."""
    q = V.literal(query_vector(spark, sf))
    straight = V.euclidean(F.col("vector"), q)
    return points(spark, sf).select("vec_id", F.when(straight <= 1e-15, 1.0).otherwise(F.round(V.conformal(F.col("vector"), q) / straight, 6)).alias("ratio"))


@_register(f"{_P} SELECT vec_id, 5::BIGINT AS n, 5::BIGINT AS inside, 5::BIGINT AS apart FROM p")
def geodesic_ball_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Five points of the ball of radius 0.3 around every point of the sphere: how many lie inside and how many differ."""
    centres = _sphere_points(spark, sf)
    rows = tangent.ball_samples(centres.withColumnRenamed("a", "point"), "sphere", 0.3, 5, 2).join(centres, "vec_id")
    a, b = F.col("a"), F.col("point")
    arc = F.acos(F.cos(a[0]) * F.cos(b[0]) + F.sin(a[0]) * F.sin(b[0]) * F.cos(a[1] - b[1]))
    return rows.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum((arc <= 0.3 + 1e-6).cast("long")).alias("inside"), F.countDistinct("point").alias("apart"))


@_register()
def atlas_quality(spark: SparkSession, sf: str) -> DataFrame:
    charts = atlas.pca_atlas(points(spark, sf), "label", DIM, AMBIENT)
    registry = tangent.Registry(charts, atlas.auto_transitions(charts))
    found = tangent.quality(atlas.locate(points(spark, sf), registry.tables(spark)["charts"]), chart_overlap_points(spark, sf), registry, 0.9)
    return spark.createDataFrame([(found["points"], float(found["coverage"]), float(found["overlap"]), found["charts"], found["transitions"], len(found["isolated"]))], "points long, coverage double, overlap double, charts int, transitions int, isolated int")


from . import catalog_more  # noqa: E402, F401  registers further queries
