"""Further queries: curved metrics, the query language's other statements, index upkeep, metric fields and sources."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import udfs
from ..functions import vectors as V
from ..operators import atlas, curved, learning, lineage, metrics, paths, search, store, tangent
from ..sources import files
from . import mql
from .catalog import AMBIENT, _ANCHORS, _MOVED, _P, _SHOT, _SPHERE, DIM, ROTATION, SHIFT, _anchors, _list, _local, _neat, _out, _register, _sampled, _sphere_points, points, query_vector, table

# Curved search and paths.

_FROM = f"{_SPHERE}, o AS (SELECT t1 AS t0, f1 AS f0 FROM e WHERE vec_id = 0), g AS (SELECT vec_id, acos(greatest(-1, least(1, cos(t1) * cos(t0) + sin(t1) * sin(t0) * cos(f1 - f0)))) AS d FROM e, o WHERE vec_id <> 0)"


def _sphere(spark: SparkSession, sf: str) -> tuple[DataFrame, list[float]]:
    """Points of the sphere, and the one to search around, which is left out."""
    rows = _sphere_points(spark, sf).select("vec_id", F.col("a").alias("vector"))
    return rows.where("vec_id <> 0"), list(rows.where("vec_id = 0").first()["vector"])


@_register(f"{_FROM} SELECT vec_id, round(d, 5) AS distance FROM g ORDER BY d, vec_id LIMIT 10")
def knn_geodesic_sphere(spark: SparkSession, sf: str) -> DataFrame:
    """Chords choose the candidates, Newton shooting ranks them."""
    rows, q = _sphere(spark, sf)
    return curved.knn(rows, q, 10, "sphere").select("vec_id", F.round("distance", 5).alias("distance"))


@_register(f"{_FROM} SELECT vec_id, round(d, 5) AS distance FROM (SELECT * FROM g ORDER BY d, vec_id LIMIT 30) WHERE d < 0.1")
def select_geodesic_sphere(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the query language, with a bound after the ranking."""
    rows, q = _sphere(spark, sf)
    text = f"SELECT vec_id, distance FROM points USING METRIC 'geodesic:sphere' WHERE geodesic_distance(vector, [{q[0]!r}, {q[1]!r}]) < 0.1 LIMIT 30"
    return mql.Engine(spark, {"points": rows}).sql(text).select("vec_id", F.round("distance", 5).alias("distance"))


@_register(f"{_FROM} SELECT vec_id, round(d, 5) AS distance FROM g WHERE d <= 0.15")
def ball_geodesic_sphere(spark: SparkSession, sf: str) -> DataFrame:
    rows, q = _sphere(spark, sf)
    return curved.ball(rows, q, 0.15, "sphere").select("vec_id", F.round("distance", 5).alias("distance"))


@_register(f"{_SPHERE}, w AS (SELECT vec_id, s::INT AS step, d, sin((1 - s / 20.0::DOUBLE) * d) / sin(d) AS wa, sin(s / 20.0::DOUBLE * d) / sin(d) AS wb, * EXCLUDE (vec_id, s, d) FROM arc, range(0, 21) t(s) WHERE vec_id % 10 = 0), x AS (SELECT vec_id, step, d, wa * sin(t1) * cos(f1) + wb * sin(t2) * cos(f2) AS x, wa * sin(t1) * sin(f1) + wb * sin(t2) * sin(f2) AS y, wa * cos(t1) + wb * cos(t2) AS z FROM w) SELECT vec_id AS path_id, step, [round(acos(greatest(-1, least(1, z))), 4) + 0, round(atan2(y, x), 4) + 0] AS point, round(d * step / 20, 5) AS arc_length FROM x")
def geodesic_path_sphere(spark: SparkSession, sf: str) -> DataFrame:
    """Great circles between pairs of points, a stated set of ids."""
    pairs = _sphere_points(spark, sf).where("vec_id % 10 = 0").withColumnRenamed("vec_id", "path_id")
    return curved.paths(pairs, "sphere").select("path_id", "step", _neat("point", 4), F.round("arc_length", 5).alias("arc_length"))


@_register(f"{_SHOT} SELECT vec_id, [round(acos(z), 6) + 0, round(atan2(y, x), 6) + 0] AS end, round(s, 6) AS arc_length FROM n")
def ivp_adaptive_sphere(spark: SparkSession, sf: str) -> DataFrame:
    """Dormand-Prince steps with the arc length."""
    rows = _sphere_points(spark, sf).select("vec_id", udfs.exp_adaptive("sphere", F.col("a"), F.array(F.lit(0.3), F.lit(0.4))).alias("r"))
    return rows.select("vec_id", F.slice("r", 1, 2).alias("end"), F.round(F.get("r", F.lit(2)), 6).alias("arc_length")).select("vec_id", _neat("end", 6), "arc_length")


@_register(f"{_P} SELECT vec_id, round(d, 6) AS distance, round(list_distance(v, qv), 6) AS residual FROM (SELECT vec_id, v, qv, list_distance(v[1:8], qv[1:8]) AS d FROM p, q WHERE label = 1 AND vec_id % 4 = 0) ORDER BY d, vec_id LIMIT 10")
def cross_modal_same_chart(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).withColumnRenamed("label", "modality").withColumn("chart", F.col("vec_id") % 4)
    return _out(curved.cross_modal(rows, query_vector(spark, sf), 0, 1, 10, DIM), "vec_id", "distance", "residual", rounded="distance residual")


def _hop(x: str, by: int) -> str:
    return f"list_transform(range(1, 9), lambda i: {x}[i % 8 + 1] + {by} * {_list(SHIFT)}[i])"


_CHAIN = [(i, i + 1, [list(map(float, r)) for r in ROTATION], [x * (i + 1) for x in SHIFT]) for i in range(3)]


@_register(f"{_P}, h AS (SELECT qv[1:8] AS x0 FROM q), h1 AS (SELECT *, {_hop('x0', 1)} AS x1 FROM h), h2 AS (SELECT *, {_hop('x1', 2)} AS x2 FROM h1), h3 AS (SELECT *, {_hop('x2', 3)} AS x3 FROM h2), u AS (SELECT 0 AS step, 0 AS chart, x0 AS x FROM h3 UNION ALL SELECT 1, 1, x1 FROM h3 UNION ALL SELECT 2, 2, x2 FROM h3 UNION ALL SELECT 3, 3, x3 FROM h3) SELECT step, chart, list_transform(x, lambda c: round(c, 6) + 0) AS point FROM u")
def multi_chart_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The query point's coordinates in every chart on the way."""
    plan = curved.chart_plan(_CHAIN, 0, 3, query_vector(spark, sf)[:DIM])
    return spark.createDataFrame([(i, c, x) for i, (c, x) in enumerate(plan)], "step int, chart int, point array<double>").select("step", "chart", _neat("point", 6))


@_register(f"{_P}, h AS (SELECT qv[1:8] AS a, {_hop('qv', 1)} AS b FROM q) SELECT s::INT AS step, list_transform(range(1, 9), lambda i: round(a[i] + (b[i] - a[i]) * s / 20.0::DOUBLE, 6) + 0) AS point FROM h, range(0, 21) t(s)")
def cross_chart_path(spark: SparkSession, sf: str) -> DataFrame:
    """From the query point in chart 1 to the same coordinates in chart 0, which the transition carries over."""
    x = query_vector(spark, sf)[:DIM]
    way = curved.cross_chart_path(_CHAIN, (1, x), (0, x))
    return spark.createDataFrame(list(enumerate(way)), "step int, point array<double>").select("step", _neat("point", 6))


# The language's other statements.


@_register(f"{_P} SELECT 0::BIGINT AS vec_id, 0.0::DOUBLE AS distance, list_transform({_MOVED}, lambda x: round(x, 6) + 0) AS vector FROM q")
def transport_statement(spark: SparkSession, sf: str) -> DataFrame:
    q = ", ".join(repr(x) for x in query_vector(spark, sf)[:DIM])
    engine = mql.Engine(spark, {}, {("a", "b"): (ROTATION, SHIFT)})
    return engine.sql(f"PARALLEL_TRANSPORT [{q}] FROM a TO b").select("vec_id", "distance", _neat("vector", 6))


_TEXTS = (
    "SELECT vec_id FROM points LIMIT 5", "TANGENT_QUERY FROM chart 'c' NEAR [1, 2] WHERE distance < 0.5 TOP_K 3", "CROSS_MODAL FROM 'a' TO 'b' TRANSPORT VIA 'overlap' NEAR [1]",
    "PARALLEL_TRANSPORT [1, 2] FROM a TO b", "SELECT vec_id FROM points WHERE geodesic_distance(vector, [1]) < 2 ORDER BY vec_id DESC", "SELECT x FROM points LIMIT 0", "CROSS_MODAL FROM 'a' TO 'b' TOP_K 0",
)


@_register("SELECT * FROM (VALUES (0, 'select', 'expensive', 3, true), (1, 'tangent', 'cheap', 4, true), (2, 'cross_modal', 'expensive', 4, true), (3, 'transport', 'moderate', 2, true), (4, 'select', 'expensive', 5, true), (5, 'error', 'error', 0, false), (6, 'error', 'error', 0, false)) t(statement, kind, tier, steps, kept)")
def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Kind, cost tier and number of planned steps of statements, and whether they outlive JSON; wrong ones are errors."""
    out = []
    for i, text in enumerate(_TEXTS):
        try:
            q = mql.parse(text)
        except mql.QueryError:
            out.append((i, "error", "error", 0, False))
            continue
        out.append((i, q.type.value, q.cost().name.lower(), len(mql.steps(q)), mql.Query.from_dict(json.loads(json.dumps(q.to_dict()))) == q))
    return spark.createDataFrame(out, "statement int, kind string, tier string, steps int, kept boolean")


@_register("SELECT * FROM (VALUES ('chart', 999, 'moderate'), ('chart', 1000, 'expensive'), ('chart', 100000, 'very_expensive'), ('other', 5, 'expensive')) t(chart, size, tier)")
def cost_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """SELECT on charts of known and unknown size."""
    q = mql.Builder().from_chart("chart").build()
    rows = [("chart", n, q.cost({"chart": n}).name.lower()) for n in (999, 1000, 100_000)]
    return spark.createDataFrame([*rows, ("other", 5, q.cost({"other": 5}).name.lower())], "chart string, size int, tier string")


# Metrics (D3, D11, D15, D16, M2, M3, M14, M18, E14).

_FULL = [[1.0 + (i == j) if abs(i - j) < 2 else 0.0 for j in range(4)] for i in range(4)]
_FULL_SQL = f"list_sum(list_transform(range(1, 5), lambda i: {{d}}[i] * list_sum(list_transform(range(1, 5), lambda j: {_list(_FULL)}[i][j] * {{d}}[j]))))"


@_register(f"{_P}, d AS (SELECT vec_id, list_transform(range(1, 5), lambda i: v[i] - qv[i]) AS d, v[1:4] AS w FROM p, q) SELECT vec_id, round(sqrt(abs({_FULL_SQL.format(d='d')})), 6) AS distance, round(sqrt(greatest({_FULL_SQL.format(d='w')}, 0)), 6) AS norm FROM d")
def mahalanobis_full(spark: SparkSession, sf: str) -> DataFrame:
    """Under a full matrix: the distance to the query, and the norm of each point as a tangent vector."""
    g, q = V.matrix_literal(_FULL), V.literal(query_vector(spark, sf)[:4])
    return points(spark, sf).select("vec_id", F.round(V.mahalanobis(_local(4), q, g), 6).alias("distance"), F.round(curved.tangent_norm(_local(4), g), 6).alias("norm"))


@_register(f"{_P} SELECT a.vec_id, round(list_distance(a.v[1:16], b.v[1:16]), 6) AS distance FROM (SELECT * FROM p) a LEFT JOIN p b ON b.vec_id = a.vec_id + 1 WHERE b.vec_id IS NOT NULL UNION ALL SELECT max(vec_id), 'inf'::DOUBLE FROM p")
def metric_frobenius(spark: SparkSession, sf: str) -> DataFrame:
    """Between each row's 4 x 4 matrix and the next one's; infinite where there is no next."""
    rows = points(spark, sf).select("vec_id", _local(16).alias("g"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("h"))
    return rows.join(after, "vec_id", "left").select("vec_id", F.round(metrics.frobenius(F.col("g"), F.col("h")), 6).alias("distance"))


@_register(f"{_ANCHORS}, w AS (SELECT anchor_id, v, list_transform(range(0, 9), lambda c: base[c // 3 + 1] * base[c % 3 + 1] + CASE WHEN c // 3 = c % 3 THEN 1 ELSE 0 END) AS g, vec_id, list_distance(v[1:3], base[1:3]) AS r FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r, anchor_id) AS k FROM w), m AS (SELECT vec_id, c, sum(exp(-0.5 * (r / 0.5) ** 2) * g[c]) / sum(exp(-0.5 * (r / 0.5) ** 2)) AS x FROM k, range(1, 10) t(c) WHERE k <= 5 GROUP BY vec_id, c) SELECT vec_id, list(round(x, 6) + 0 ORDER BY c) AS g FROM m GROUP BY vec_id")
def rbf_metric_full(spark: SparkSession, sf: str) -> DataFrame:
    """Interpolation of 3 x 3 matrices."""
    local = points(spark, sf).select("vec_id", _local(3).alias("vector"))
    cells = F.array(*[F.get("vector", F.lit(i)) * F.get("vector", F.lit(j)) + F.lit(1.0 if i == j else 0.0) for i in range(3) for j in range(3)])
    anchors = _sampled(local).select(F.col("vec_id").alias("anchor_no"), F.col("vector").alias("coords"), cells.alias("g"), F.lit(1.0).alias("weight"), F.lit(0.5).alias("sigma"))
    return metrics.rbf_metric(local, anchors, full=True).select("vec_id", _neat("g", 6))


@_register(f"{_ANCHORS}, o AS (SELECT anchor_id, base[1:8] AS x, row_number() OVER (ORDER BY anchor_id) - 1 AS n FROM a), g AS (SELECT a.n, a.anchor_id, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.n ORDER BY list_distance(a.x, b.x)) AS r FROM o a JOIN o b ON b.n < a.n) SELECT o.anchor_id, round(CASE WHEN d IS NULL THEN 1.0 ELSE greatest(1e-6, d) END, 6) AS sigma FROM o LEFT JOIN g ON g.n = o.n AND r = least(3, o.n)")
def anchor_bandwidths(spark: SparkSession, sf: str) -> DataFrame:
    """Sigma of each anchor on insertion in the order of ids."""
    held = sorted((r["anchor_id"], list(r["base"])[:DIM]) for r in search.small_side(_anchors(spark, sf)))
    sigmas = metrics.anchor_sigmas([x for _, x in held])
    return spark.createDataFrame([(a, round(s, 6)) for (a, _), s in zip(held, sigmas, strict=True)], "anchor_id long, sigma double")


@_register(f"{_SPHERE} SELECT vec_id, [round(cos(t1) / sin(t1) ** 3, 4) + 0, 0.0::DOUBLE] AS proxy FROM e")
def mean_curvature_sphere(spark: SparkSession, sf: str) -> DataFrame:
    return _sphere_points(spark, sf).select("vec_id", udfs.mean_curvature("sphere", F.col("a")).alias("proxy")).select("vec_id", _neat("proxy", 4))


@_register("SELECT * FROM (VALUES (0.25::DOUBLE, round(2 ** 0.25, 6), round(9 ** 0.75, 6)), (0.5, round(2 ** 0.5, 6), round(9 ** 0.5, 6)), (1.0, 2.0, 1.0)) t(t, first, second)")
def metric_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    """From diag(1, 9) to diag(2, 1) along the log-Euclidean line."""
    rows = [(t, *np.round(np.diag(G.interpolate_spd(np.diag([1.0, 9.0]), np.diag([2.0, 1.0]), t)), 6).tolist()) for t in (0.25, 0.5, 1.0)]
    return spark.createDataFrame(rows, "t double, first double, second double")


@_register(f"{_P} SELECT round(avg(v[1] * v[1]), 5) AS f11, round(avg(v[1] * v[2]), 5) AS f12, round(avg(v[2] * v[2]), 5) AS f22 FROM p")
def fisher_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Fisher matrix of a unit normal's mean at 0, whose scores are the samples; differences of each sample in its task."""

    def scores(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, 2)
            if len(x):
                m = G.fisher_matrix(lambda theta, s: -0.5 * ((s - theta) ** 2).sum(-1), np.zeros(2), x) * len(x)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (m[0, 0], m[0, 1], m[1, 1], float(len(x)))], ["a", "b", "c", "n"])

    sums = points(spark, sf).select(_local(2)).mapInArrow(scores, "a double, b double, c double, n double").agg(*[F.sum(c).alias(c) for c in "abcn"])
    return sums.select(*[F.round(F.col(c) / F.col("n"), 5).alias(name) for c, name in (("a", "f11"), ("b", "f12"), ("c", "f22"))])


# Upkeep and sources.


@_register(f"{_ANCHORS}, u AS (SELECT vec_id, v FROM p WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id, list_transform(v, lambda x: -x) FROM p WHERE vec_id % 14 = 0), x AS (SELECT u.vec_id, anchor_id, list_distance(u.v, base) AS d, row_number() OVER (PARTITION BY u.vec_id ORDER BY list_distance(u.v, base), anchor_id) AS k FROM u, a) SELECT anchor_id, count(*) AS n, round(min(d), 6) AS min_d, round(max(d), 6) AS max_d, round(avg(d), 6) AS avg_d FROM x WHERE k = 1 GROUP BY anchor_id")
def index_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics after every 7th point was deleted, half of them came back reversed and all others were updated in place."""
    p, anchors = points(spark, sf).select("vec_id", "vector"), _anchors(spark, sf)
    assigned = lineage.checkpointed(search.assign_anchors(p, anchors))
    rest = curved.index_delete(assigned, p.where("vec_id % 7 = 0").select("vec_id"))
    back = p.where("vec_id % 14 = 0").withColumn("vector", V.scaled(F.col("vector"), F.lit(-1.0)))
    grown = curved.index_insert(rest, back, anchors)
    return _out(search.anchor_stats(curved.index_update(grown, p.where("vec_id % 7 = 1"), anchors)), "anchor_id", "n", "min_d", "max_d", "avg_d", rounded="min_d max_d avg_d")


@_register(f"{_P}, n AS (SELECT max(label) + 1 AS next FROM p) SELECT label, count(*) AS n, round(sum(list_sum(v[1:8])), 4) AS total, max(len(v))::INT AS width FROM (SELECT label, v[1:8] AS v FROM p UNION ALL SELECT next, list_concat(v[1:6], [0.0, 0.0]) FROM p, n WHERE vec_id % 3 = 0) GROUP BY label")
def evolved_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of six coordinates join a table of eight as a new modality."""
    p = points(spark, sf).select("vec_id", "label", _local().alias("vector"))
    new = p.where("vec_id % 3 = 0").select("vec_id", _local(6).alias("vector"))
    rows = curved.evolve(p, new, DIM, "label")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(V.total(F.col("vector"))), 4).alias("total"), F.max(F.size("vector")).alias("width"))


@_register("SELECT count(*) AS n, max(vec_id) + 1 AS first, max(vec_id) + count(*) AS last, count(*) AS kinds FROM embeddings")
def inserted_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that continue those of the table without gaps."""
    p = points(spark, sf)
    new = store.validated(store.with_new_ids(p, p.select("vector"), "vec_id"), 64)
    return new.agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.countDistinct("vec_id").alias("kinds"))


@_register(f"{_P} SELECT count(*) AS n, round(sum(v[1]), 5) AS a, round(sum(v[2]), 5) AS b FROM p")
def csv_with_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of numbers among blank lines, comments, a header and rows of another length."""
    path = f"{lineage.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    numbers = points(spark, sf).select(F.concat_ws(", ", _local(2)).alias("value"), "vec_id")
    noise = F.explode(F.array(F.col("value"), F.lit(""), F.lit("# 1, 2"), F.lit("% 3, 4"), F.lit("x, y"), F.lit("1, 2, 3")))
    numbers.select(noise.alias("value")).write.text(path)
    v = F.col("vector")
    return files.read_csv(spark, path, 2).agg(F.count("*").alias("n"), F.round(F.sum(v[0]), 5).alias("a"), F.round(F.sum(v[1]), 5).alias("b"))


@_register(f"{_P} SELECT 'points' AS name, count(*) AS n, round(sum(v[1]), 5) AS total FROM p WHERE label = 3 UNION ALL SELECT 'charts', count(DISTINCT label), 0 FROM p")
def stored_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A store written with points partitioned by label and read back with a filter on the partition."""
    path = f"{lineage.shared_folder(spark)}/store-{uuid.uuid4().hex}"
    p = points(spark, sf)
    files.save_store({"points": p, "charts": p.select("label").distinct()}, path, "label")
    held = files.load_store(spark, path, ("points", "charts"))
    some = held["points"].where("label = 3").agg(F.lit("points").alias("name"), F.count("*").alias("n"), F.round(F.sum(F.get("vector", F.lit(0))), 5).alias("total"))
    return some.unionByName(held["charts"].agg(F.lit("charts").alias("name"), F.count("*").alias("n"), F.lit(0.0).alias("total")))


@_register("WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL) SELECT event_type, round(max(CASE WHEN r = least(floor(c * 0.99), c - 1) THEN value END), 6) AS p99 FROM n GROUP BY event_type")
def latency_p99(spark: SparkSession, sf: str) -> DataFrame:
    return learning.latency_summary(table(spark, sf, "events"), "event_type", "value").select("event_type", F.round("p99", 6).alias("p99"))


# Boxes, ids by modality, stored metrics, indices, lengths and accelerations.


@_register(f"{_P} SELECT vec_id, round(list_distance(v, qv), 6) AS distance FROM p, q ORDER BY list_distance(v, qv), vec_id LIMIT 10")
def knn_pruned_by_boxes(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return _out(tangent.pruned_knn(p, atlas.bounds(p, "label", AMBIENT, members=True), query_vector(spark, sf), 10, "label"), "vec_id", "distance")


@_register("SELECT vec_id AS old_id, label, max(vec_id) OVER (PARTITION BY label) + row_number() OVER (PARTITION BY label ORDER BY vec_id) AS vec_id FROM embeddings")
def inserted_by_modality(spark: SparkSession, sf: str) -> DataFrame:
    """Every row once more, with ids that continue its label's."""
    p = points(spark, sf)
    new = p.select(F.col("vec_id").alias("old_id"), "label", "vector")
    return store.with_modality_ids(p, new, [F.col("old_id")], "label", "vec_id").select("old_id", "label", "vec_id")


@_register(f"{_P} SELECT vec_id, round(sqrt(CASE WHEN label < 5 THEN label + 1 ELSE 1 END * (v[1] ** 2 + v[2] ** 2 + v[3] ** 2 + v[4] ** 2)), 6) AS norm FROM p")
def metric_store_norms(spark: SparkSession, sf: str) -> DataFrame:
    """Length of each point's first coordinates under its label's metric; labels from 5 on have none registered."""
    p = points(spark, sf).select("vec_id", "label", _local(4).alias("vector"))
    kind = p.schema["label"].dataType.simpleString()
    held = spark.createDataFrame([(i, (np.eye(4) * (i + 1)).tolist()) for i in range(5)], f"label {kind}, g array<array<double>>")
    return metrics.evaluate(p, held, 4, "label").select("vec_id", F.round(curved.tangent_norm(F.col("vector"), F.col("g")), 6).alias("norm"))


_LOWERED = f"list_transform(range(1, 5), lambda i: list_sum(list_transform(range(1, 5), lambda j: {_list(_FULL)}[i][j] * v[j])))"


@_register(f"{_P} SELECT vec_id, list_transform({_LOWERED}, lambda x: round(x, 5) + 0) AS low, list_transform(v[1:4], lambda x: round(x, 5) + 0) AS back FROM p")
def indices_lowered_and_raised(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).select("vec_id", metrics.lowered(_local(4), _FULL).alias("low"))
    return rows.withColumn("back", metrics.raised(F.col("low"), _FULL)).select("vec_id", _neat("low", 5), _neat("back", 5))


@_register(f"{_P}, m AS (SELECT vec_id, v, {_LOWERED} AS w FROM p) SELECT vec_id, list_transform(w, lambda x: round(x * sqrt(list_dot_product(v[1:4], v[1:4])) / sqrt(list_dot_product(w, w)), 5) + 0) AS moved FROM m")
def transport_keeping_length(spark: SparkSession, sf: str) -> DataFrame:
    """Tangent vectors by the map's matrix, scaled to the length that they had."""
    rows = points(spark, sf).select("vec_id", _local(4).alias("v"))
    moved = paths.with_length_of(V.matvec(V.matrix_literal(_FULL), F.col("v")), F.col("v"))
    return rows.select("vec_id", moved.alias("moved")).select("vec_id", _neat("moved", 5))


@_register(f"{_SPHERE} SELECT vec_id, [round(sin(t1) * cos(t1) * 0.16, 5) + 0, round(-0.24 * cos(t1) / sin(t1), 5) + 0] AS a FROM e")
def acceleration_sphere(spark: SparkSession, sf: str) -> DataFrame:
    velocity = F.array(F.lit(0.3), F.lit(0.4))
    return _sphere_points(spark, sf).select("vec_id", udfs.acceleration("sphere", F.col("a"), velocity).alias("a")).select("vec_id", _neat("a", 5))
