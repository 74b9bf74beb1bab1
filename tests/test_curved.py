"""Curved search and paths, adaptive steps, index upkeep, ranks and named metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartlake.functions import geometry as G
from chartlake.functions import udfs
from chartlake.functions import vectors as V
from chartlake.operators import curved, lineage, metrics, search
from chartlake.plans import mql

RNG = np.random.default_rng(11)
SPHERE = np.column_stack([RNG.uniform(0.6, 2.4, 300), RNG.uniform(-0.8, 0.8, 300)])


def arc(a, b):
    return np.arccos(np.clip(np.cos(a[..., 0]) * np.cos(b[..., 0]) + np.sin(a[..., 0]) * np.sin(b[..., 0]) * np.cos(a[..., 1] - b[..., 1]), -1, 1))


@pytest.fixture(scope="module")
def sphere(spark):
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(SPHERE)] + [(900, None, 0)]
    return spark.createDataFrame(rows, "vec_id long, vector array<double>, chart int").cache()


def test_curved_search(sphere):
    q = np.array([1.3, 0.1])
    d = arc(SPHERE, q)
    got = curved.knn(sphere, q.tolist(), 8, "sphere").collect()
    assert [r["vec_id"] for r in got] == np.argsort(d)[:8].tolist()
    np.testing.assert_allclose([r["distance"] for r in got], np.sort(d)[:8], atol=1e-6)
    near = float(np.sort(d)[4])
    assert curved.knn(sphere, q.tolist(), 8, "sphere", max_distance=near + 1e-6).count() == 5
    own = curved.knn(sphere, q.tolist(), 4, "sphere", chart=("chart", 1)).collect()
    assert [r["vec_id"] for r in own] == [i for i in np.argsort(d).tolist() if i % 3 == 1][:4]
    assert {r["vec_id"] for r in curved.ball(sphere, q.tolist(), 0.3, "sphere").collect()} == set(np.flatnonzero(d <= 0.3).tolist())
    with pytest.raises(ValueError):
        curved.knn(sphere, q.tolist(), 0, "sphere")
    with pytest.raises(ValueError):
        curved.ball(sphere, q.tolist(), -1.0, "sphere")


def test_named_metrics(spark):
    rows = spark.createDataFrame([(1, [0.5, 0.5], [1.0, 0.0]), (2, [0.9, 0.1], [0.2, 0.8])], "vec_id long, a array<double>, b array<double>")
    for name in ("geodesic:flat", "chord:flat", "curvature:flat", "euclidean", "geodesic"):
        got = [r[0] for r in rows.select(udfs.named(name)(F.col("a"), F.col("b"))).collect()]
        np.testing.assert_allclose(got, [0.5**0.5, (0.49 * 2) ** 0.5], rtol=1e-6)
    for name in ("geodesic:nowhere", "nothing", "euclidean:sphere"):
        with pytest.raises(ValueError):
            udfs.named(name)
    engine = mql.Engine(spark, {"points": rows.select("vec_id", F.col("a").alias("vector"))})
    for name in ("wasserstein", "fisher_rao", "log_euclidean" if False else "cosine"):
        assert engine.sql(f"SELECT vec_id, distance FROM points USING METRIC {name} WHERE geodesic_distance(vector, [1, 0.0]) < 50").count() == 2


def test_adaptive_steps_and_presets():
    x, v = np.array([[1.0, 0.2], [1.4, -0.3]]), np.array([[0.5, 0.4], [-0.2, 0.9]])
    end, speed, length = G.solve_adaptive(G.sphere, x, v)
    np.testing.assert_allclose(end, G.exp_map(G.sphere, x, v, 400), atol=1e-7)
    np.testing.assert_allclose(length, G.length(G.sphere, x, v), atol=1e-7)
    np.testing.assert_allclose(G.length(G.sphere, end, speed), length, atol=1e-6)
    for preset, close in (("fast", 1e-4), ("default", 1e-7), ("accurate", 1e-9)):
        np.testing.assert_allclose(G.geodesic_distance(G.sphere, x, end, preset), length, atol=close)
    samples = RNG.normal(size=(500, 2))
    np.testing.assert_allclose(G.fisher_matrix(lambda t, s: -0.5 * ((s - t) ** 2).sum(-1), np.zeros(2), samples), samples.T @ samples / 500, atol=1e-6)
    np.testing.assert_allclose(G.jacobian(lambda p: np.stack([p[..., 0] * p[..., 1], p[..., 0] ** 2], -1), np.array([2.0, 3.0])), [[3, 2], [4, 0]], atol=1e-6)


def test_paths_over_charts():
    turn = [[0.0, -1.0], [1.0, 0.0]]
    maps = [(0, 1, turn, [1.0, 0.0]), (1, 2, turn, [0.0, 2.0])]
    plan = curved.chart_plan(maps, 0, 2, [1.0, 0.0])
    assert [c for c, _ in plan] == [0, 1, 2] and np.allclose([x for _, x in plan], [[1, 0], [1, 1], [-1, 3]])
    assert np.allclose(curved.chart_plan(maps, 2, 0, [-1.0, 3.0])[-1][1], [1, 0])  # maps run backwards
    way = curved.cross_chart_path(maps, (0, [0.0, 0.0]), (2, [-1.0, 3.0]), 4)
    assert np.allclose(way, np.linspace([0, 0], [1, 0], 5))
    with pytest.raises(KeyError):
        curved.chart_plan(maps, 0, 7, [1.0, 0.0])


def test_index_upkeep(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "vec_id long, vector array<double>")
    anchors = spark.createDataFrame([(0, [2.0, 0.0]), (1, [15.0, 0.0])], "anchor_id long, base array<double>")
    index = search.assign_anchors(rows, anchors)
    new = spark.createDataFrame([(30, [1.0, 1.0])], rows.schema)
    assert curved.index_insert(index, new, anchors).where("anchor_id = 0").count() == index.where("anchor_id = 0").count() + 1
    for wrong in (new.unionAll(new), rows.where("vec_id = 3")):
        with pytest.raises(ValueError):
            curved.index_insert(index, wrong, anchors)
    moved = curved.index_update(index, spark.createDataFrame([(0, [19.0, 0.0])], rows.schema), anchors)
    assert moved.where("vec_id = 0").first()["anchor_id"] == 1 and moved.count() == 20
    assert curved.index_delete(index, rows.where("vec_id < 5")).count() == 15


def test_numbered(spark):
    rows = spark.createDataFrame([("a" if i % 4 else None, (i * 7) % 50) for i in range(50)], "kind string, x int").repartition(5)
    got = lineage.numbered(rows, "kind", [F.col("x")]).collect()
    for kind in ("a", None):
        own = sorted((r["r"], r["x"]) for r in got if r["kind"] == kind)
        assert [r for r, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)
        assert {r["r_of"] for r in got if r["kind"] == kind} == {len(own)}
    assert lineage.numbered(rows.where("false"), None, [F.col("x")]).collect() == []


def test_full_metric_field(spark, sphere):
    anchors = spark.createDataFrame([(i, SPHERE[i].tolist(), (np.eye(2) * (i + 1) + 0.1).ravel().tolist(), 1.0, 0.4) for i in range(9)], "anchor_no int, coords array<double>, g array<double>, weight double, sigma double")
    got = {r["vec_id"]: r["g"] for r in metrics.rbf_metric(sphere, anchors, full=True).collect()}
    for i in (20, 40):
        r = np.linalg.norm(SPHERE[:9] - SPHERE[i], axis=1)
        near = np.argsort(r)[:5]
        w = np.exp(-0.5 * (r[near] / 0.4) ** 2)
        want = sum(a * (np.eye(2) * (k + 1) + 0.1) for a, k in zip(w, near, strict=True)) / w.sum()
        np.testing.assert_allclose(got[i], want.ravel())
    assert set(map(tuple, (r["g"] for r in metrics.rbf_metric(sphere, anchors.where("false"), full=True).collect()))) == {(1.0, 0.0, 0.0, 1.0)}


def test_evolve(spark):
    old = spark.createDataFrame([(1, [1.0, 2.0], 4)], "vec_id long, vector array<double>, modality int")
    new = spark.createDataFrame([(2, [5.0]), (3, [6.0, 7.0, 8.0])], "vec_id long, vector array<double>")
    got = {r["vec_id"]: (r["vector"], r["modality"]) for r in curved.evolve(old, new, 2).collect()}
    assert got == {1: ([1.0, 2.0], 4), 2: ([5.0, 0.0], 5), 3: ([6.0, 7.0], 5)}
    assert V.distance("euclidean") and curved.evolve(old.where("false"), new, 2).first()["modality"] == 0


def test_symbols_and_accelerations_to_rounding():
    x = np.column_stack([RNG.uniform(0.7, 2.2, 200), RNG.uniform(0.5, 1.7, 200)])
    t, y, gamma = x[:, 0], x[:, 1], G.christoffel(G.sphere, x)
    np.testing.assert_allclose(gamma[:, 0, 1, 1], -np.sin(t) * np.cos(t), rtol=0, atol=1e-15)
    np.testing.assert_allclose(gamma[:, 1, 0, 1], np.cos(t) / np.sin(t), rtol=0, atol=2e-15)
    np.testing.assert_allclose(G.christoffel(G.half_plane, x)[:, 1], np.stack([np.stack([1 / y, 0 * y], 1), np.stack([0 * y, -1 / y], 1)], 1), rtol=0, atol=2e-15)
    got = G.acceleration(G.sphere, x, np.broadcast_to([0.3, 0.4], x.shape))
    np.testing.assert_allclose(got, np.column_stack([0.16 * np.sin(t) * np.cos(t), -0.24 * np.cos(t) / np.sin(t)]), rtol=0, atol=2e-15)
    for name, g in G.METRICS.items():  # against differences, as metrics without a closed form have them
        np.testing.assert_allclose(G.metric_gradient(g, x), G.metric_gradient(lambda p, g=g: g(p), x), rtol=1e-6, atol=1e-6, err_msg=name)
    v = RNG.normal(size=(200, 3))
    full = lambda p: np.eye(3) * (2 + p[..., :1, None] ** 2) + 0.1 * (p[..., :, None] * p[..., None, :])
    x3 = RNG.normal(size=(200, 3))
    np.testing.assert_allclose(G.acceleration(full, x3, v), -np.einsum("rijk,rj,rk->ri", G.christoffel(full, x3), v, v), rtol=1e-9, atol=1e-9)


def test_adaptive_steps_to_rounding():
    x = np.column_stack([RNG.uniform(0.8, 1.8, 300), RNG.uniform(-0.4, 0.4, 300)])
    t, f = x.T
    s = np.sqrt(0.09 + 0.16 * np.sin(t) ** 2)
    at = np.stack([np.sin(t) * np.cos(f), np.sin(t) * np.sin(f), np.cos(t)], 1)
    way = np.stack([0.3 * np.cos(t) * np.cos(f) - 0.4 * np.sin(t) * np.sin(f), 0.3 * np.cos(t) * np.sin(f) + 0.4 * np.sin(t) * np.cos(f), -0.3 * np.sin(t)], 1)
    to = np.cos(s)[:, None] * at + (np.sin(s) / s)[:, None] * way
    end, _, arc_length = G.solve_adaptive(G.sphere, x, np.broadcast_to([0.3, 0.4], x.shape))
    np.testing.assert_allclose(end, np.column_stack([np.arccos(to[:, 2]), np.arctan2(to[:, 1], to[:, 0])]), rtol=0, atol=1e-14)
    np.testing.assert_allclose(arc_length, s, rtol=0, atol=1e-14)
    far, _, _ = G.solve_adaptive(G.flat, np.array([[1e6, -3e5]]), np.array([[1.0, 2.0]]))  # the tolerance is relative
    np.testing.assert_allclose(far, [[1e6 + 1, -3e5 + 2]], rtol=1e-14)


def test_log_maps_to_rounding():
    x1, y1, x2, y2 = RNG.uniform(-0.5, 0.5, 300), RNG.uniform(1, 1.5, 300), RNG.uniform(-0.5, 0.5, 300), RNG.uniform(1, 1.5, 300)
    c = (x2**2 + y2**2 - x1**2 - y1**2) / (2 * (x2 - x1))
    d = np.arccosh(1 + ((x2 - x1) ** 2 + (y2 - y1) ** 2) / (2 * y1 * y2))
    size = d * y1 * np.sign(x2 - x1) / np.hypot(x1 - c, y1)
    v, done = G.log_map(G.half_plane, np.column_stack([x1, y1]), np.column_stack([x2, y2]))
    assert done.all()
    np.testing.assert_allclose(v, np.column_stack([y1 * size, (c - x1) * size]), rtol=0, atol=5e-13)
    np.testing.assert_allclose(G.geodesic_distance(G.half_plane, np.column_stack([x1, y1]), np.column_stack([x2, y2])), d, rtol=0, atol=5e-13)


def test_geodesic_paths_to_rounding():
    a, b = (np.column_stack([RNG.uniform(1.0, 1.7, 40), RNG.uniform(lo, lo + 0.5, 40)]) for lo in (-0.4, 0.6))
    d, t = arc(a, b)[:, None], np.arange(21) / 20
    p, q = (np.stack([np.sin(x[:, 0]) * np.cos(x[:, 1]), np.sin(x[:, 0]) * np.sin(x[:, 1]), np.cos(x[:, 0])], 1)[:, None] for x in (a, b))
    way = (np.sin((1 - t) * d) / np.sin(d))[..., None] * p + (np.sin(t * d) / np.sin(d))[..., None] * q
    want = np.stack([np.arccos(way[..., 2]), np.arctan2(way[..., 1], way[..., 0])], -1)
    np.testing.assert_allclose(G.geodesic_path(G.sphere, a, b), want, rtol=0, atol=2e-12)
    middle, straight = (a + b) / 2, G.chord(G.sphere, a, b)
    np.testing.assert_allclose(G.curvature_corrected(G.sphere, a, b), straight * np.maximum(0.5, 1 - straight**2 / 12), rtol=0, atol=1e-12)
    np.testing.assert_allclose(G.scalar_curvature(G.half_plane, middle[:, ::-1] + [0.0, 1.0]), -2.0, rtol=0, atol=1e-9)
