"""The vector store: search, charts, transitions, metrics, paths, tables, sources."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartlake.functions import geometry as G
from chartlake.functions import vectors as V
from chartlake.operators import atlas, learning, metrics, paths, search, store
from chartlake.sources import files

RNG = np.random.default_rng(42)
DATA = RNG.normal(size=(200, 10))


@pytest.fixture(scope="module")
def points(spark):
    return files.from_numpy(spark, DATA).cache()


def brute(q, k, norm=2):
    d = np.linalg.norm(DATA - q, ord=norm, axis=1)
    return [(int(i), pytest.approx(d[i])) for i in np.lexsort((np.arange(len(d)), d))[:k]]


@pytest.mark.parametrize("k", [1, 7, 500])
def test_knn(points, k):
    q = RNG.normal(size=10)
    got = [(r["vec_id"], r["distance"]) for r in search.knn(points, q, k).collect()]
    assert got == brute(q, k)
    got = [(r["vec_id"], r["distance"]) for r in search.knn(points, q, k, "manhattan").collect()]
    assert got == brute(q, k, 1)


def test_knn_limits(points):
    q = DATA[3]
    with pytest.raises(ValueError):
        search.knn(points, q, 0)
    near = search.knn(points, q, 50, max_distance=3.0).collect()
    assert all(r["distance"] <= 3.0 for r in near) and near[0]["vec_id"] == 3
    sizes = [search.ball(points, q, r).count() for r in (0.0, 2.0, 4.0, 100.0)]
    assert sizes == sorted(sizes) and sizes[0] == 1 and sizes[-1] == 200


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_batch_equals_single(spark, points, monkeypatch, metric):
    monkeypatch.setattr(search, "BLOCK", 4)
    queries = points.where("vec_id < 11").select(F.col("vec_id").alias("query_id"), "vector")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["distance"]) for r in search.knn_batch(points, queries, 4, metric).collect()}
    for q in range(11):
        want = [(r["vec_id"], pytest.approx(r["distance"], abs=1e-12)) for r in search.knn(points, DATA[q], 4, metric).collect()]
        assert [got[q, i] for i in range(1, 5)] == want
    assert search.knn_batch(points, queries.where("false"), 3).collect() == []


def test_ties_nulls_and_few_points(spark):
    p = spark.createDataFrame([(5, [0.0, 1.0]), (2, [1.0, 0.0]), (9, None), (7, [0.0, -1.0])], "vec_id long, vector array<double>")
    assert [r["vec_id"] for r in search.knn(p, [0.0, 0.0], 2).collect()] == [2, 5]
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    assert [r["vec_id"] for r in search.knn_batch(p, q, 10).orderBy("rank").collect()] == [2, 5, 7]


def test_anchor_index(points):
    anchors = search.farthest_points(points, 6, 0)
    assert len({a for a, _ in anchors}) == 6
    gap = np.min([np.linalg.norm(DATA - np.array(b), axis=1) for _, b in anchors[:5]], axis=0)
    assert anchors[5][0] == int(np.argmax(gap))
    table = points.sparkSession.createDataFrame([(int(a), b) for a, b in anchors], "anchor_id long, base array<double>")
    assigned = search.assign_anchors(points, table).cache()
    for r in assigned.collect():
        d = [np.linalg.norm(DATA[r["vec_id"]] - np.array(b)) for _, b in anchors]
        assert r["anchor_distance"] == pytest.approx(min(d)) and r["anchor_id"] == anchors[int(np.argmin(d))][0]
    all_probes = search.anchor_search(assigned, anchors, DATA[8].tolist(), 5, probes=6).collect()
    assert [r["vec_id"] for r in all_probes] == [i for i, _ in brute(DATA[8], 5)]
    assert search.anchor_search(assigned, anchors, DATA[8].tolist(), 5, probes=1).first()["vec_id"] == 8
    assert search.assign_anchors(points, table.where("false")).count() == 0


def test_linear_chart_round_trip(spark, points):
    chart, share = atlas.pca_chart(points, 0, 10, 10)
    origin, basis = V.literal(chart[1]), V.matrix_literal(chart[2])
    np.testing.assert_allclose(np.array(chart[2]) @ np.array(chart[2]).T, np.eye(10), atol=1e-9)
    back = atlas.embed(atlas.project(F.col("vector"), origin, basis), origin, basis)
    assert points.select(F.max(V.euclidean(F.col("vector"), back))).first()[0] < 1e-9
    assert sum(share) == pytest.approx(1) and list(share) == sorted(share, reverse=True)
    cov = np.cov(DATA, rowvar=False, bias=True)
    top = np.array(chart[2][:1])
    assert (top @ cov @ top.T).item() == pytest.approx(np.linalg.eigvalsh(cov)[-1])


def test_grouped_charts_and_locate(spark, points):
    rows = points.withColumn("part", (F.col("vec_id") % 3).cast("int"))
    charts = atlas.pca_atlas(rows, "part", 4, 10)
    single = atlas.pca_chart(rows.where("part = 1"), 1, 4, 10)[0]
    np.testing.assert_allclose(charts[1][1], single[1])
    near = atlas.locate(points, spark.createDataFrame(charts, atlas.CHARTS), keep=2).collect()
    for r in near:
        y = DATA[r["vec_id"]]
        gaps = [np.linalg.norm((y - o) - np.array(b).T @ (np.array(b) @ (y - np.array(o)))) for _, o, b in charts]
        assert r["residual"] == pytest.approx(sorted(gaps)[r["rank"] - 1])


def test_affine_and_rotation_fits(spark):
    x = RNG.normal(size=(80, 4))
    q, _ = np.linalg.qr(RNG.normal(size=(4, 4)))
    q[0] *= np.sign(np.linalg.det(q))
    pairs = spark.createDataFrame([(a.tolist(), (q @ a + 1.5).tolist()) for a in x], "x array<double>, y array<double>")
    for m, b in (atlas.affine_fit(pairs, 4), atlas.procrustes_fit(pairs, 4)):
        np.testing.assert_allclose(m, q, atol=1e-8)
        np.testing.assert_allclose(b, np.full(4, 1.5), atol=1e-8)


def test_transitions_and_paths(spark):
    steps = [(0, 1, [[2.0, 0.0], [0.0, 2.0]], [1.0, 0.0]), (1, 2, [[0.0, 1.0], [1.0, 0.0]], [0.0, 5.0])]
    m, b = atlas.compose(steps, atlas.shortest_chain(steps, 0, 2))
    np.testing.assert_allclose(m @ [3, 4] + b, [8, 12])
    m, b = atlas.compose(steps, [2, 1, 0])
    np.testing.assert_allclose(m @ [8, 12] + b, [3, 4])
    with pytest.raises(KeyError):
        atlas.compose(steps, atlas.shortest_chain(steps, 0, 9))
    edges = spark.createDataFrame([(0, 1), (1, 2), (5, 6), (3, 2)], "src int, tgt int")
    assert {r["chart"]: r["hops"] for r in atlas.chart_paths(edges, 0, spark).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_knn_graph(spark, points):
    edges = {(r["i"], r["j"]): r["w"] for r in atlas.knn_graph(points, 3).collect()}
    want = {}
    for i in range(200):
        d = np.linalg.norm(DATA - DATA[i], axis=1)
        d[i] = np.inf
        for j in np.argsort(d)[:3]:
            for e in ((i, int(j)), (int(j), i)):
                want[e] = want.get(e, 0) + math.exp(-d[j])
    assert edges == {e: pytest.approx(w) for e, w in want.items()}


def test_communities():
    def clique(at):
        return [(at + i, at + j, 1.0) for i in range(6) for j in range(i)]

    found = atlas.communities(clique(0) + clique(10) + clique(20) + [(0, 10, 0.1), (10, 20, 0.1)])
    assert len(set(found.values())) == 3 and all(len({found[at + i] for i in range(6)}) == 1 for at in (0, 10, 20))
    assert len(set(atlas.tuned_communities(clique(0) + clique(10) + [(0, 10, 0.1)], 2).values())) == 2
    merged = atlas.merge_small({0: [0.0], 1: [0.1], 2: [5.0], 3: [5.1], 4: [4.0]}, {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}, 2)
    assert merged[4] == 1


def test_geodesics_on_the_sphere():
    a, b = np.array([1.1, 0.2]), np.array([1.7, 1.1])
    arc = math.acos(math.cos(a[0]) * math.cos(b[0]) + math.sin(a[0]) * math.sin(b[0]) * math.cos(a[1] - b[1]))
    assert G.geodesic_distance(G.sphere, a, b) == pytest.approx(arc, rel=1e-6)
    assert G.path_length(G.sphere, G.shortest_path(G.sphere, a, b)) == pytest.approx(arc, rel=5e-3)
    assert G.scalar_curvature(G.sphere, a) == pytest.approx(2, abs=1e-4)
    assert G.sectional_curvature(G.sphere, a, np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1, abs=1e-4)
    assert G.scalar_curvature(G.half_plane, np.array([0.3, 1.4])) == pytest.approx(-2, abs=1e-4)
    gamma = G.christoffel(G.sphere, a)
    assert gamma[0, 1, 1] == pytest.approx(-math.sin(a[0]) * math.cos(a[0])) and gamma[1, 0, 1] == pytest.approx(1 / math.tan(a[0]))
    for method in ("rk4", "verlet"):
        end = G.solve_ivp(G.sphere, a, np.array([0.3, 0.4]), 1.0, 400, method)[0][-1]
        np.testing.assert_allclose(end, G.exp_map(G.sphere, a, np.array([0.3, 0.4]), 400), atol=1e-3)


def test_transport_keeps_length_and_turns_by_area():
    loop = np.array([[1.0, 2 * math.pi * k / 200] for k in range(201)])
    v = np.array([1.0, 0.0])
    out = G.parallel_transport(G.sphere, loop, v, 2)
    g = G.sphere(loop[0])
    assert out @ g @ out == pytest.approx(v @ g @ v, rel=1e-6)
    angle = 2 * math.pi * (1 - math.cos(1.0))  # the cap's area
    assert out[0] == pytest.approx(math.cos(angle), abs=1e-4)
    np.testing.assert_allclose(G.parallel_transport(G.flat, np.array([[0.0, 0], [1, 2], [3, 1]]), np.array([1.0, 2])), [1, 2])


def test_divergences_and_matrices(spark):
    two = np.array([[0.0, 1], [1, 0]])
    assert G.sinkhorn(np.array([1.0, 0]), np.array([0, 1.0]), two) == pytest.approx(1)
    assert G.sinkhorn(np.array([0.5, 0.5]), np.array([0.5, 0.5]), two, 0.01) == pytest.approx(0, abs=1e-3)
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.fisher_rao(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0, abs=1e-7), pytest.approx(math.pi)]
    a, b = np.diag([1.0, 4.0]), np.array([[2.0, 0.5], [0.5, 1.0]])
    np.testing.assert_allclose(G.interpolate_spd(a, b, 1.0), b, atol=1e-9)
    assert G.log_euclidean(a, a) == pytest.approx(0)
    np.testing.assert_allclose(G.sqrt_spd(b) @ G.sqrt_spd(b), b)
    assert np.linalg.eigvalsh(G.ensure_spd(-np.eye(2)))[0] > 0 and np.linalg.eigvalsh(G.nearest_spd(-np.eye(2)))[0] > 0
    np.testing.assert_allclose(G.gram_schmidt(np.array([[1.0, 1], [2, 2], [0, 1]])) @ np.array([[1.0, 1], [2, 2]]).T / math.sqrt(2), [[1, 2], [0, 0]], atol=1e-9)
    turn = G.tangent_rotation(np.eye(3)[:2], np.eye(3)[1:])
    np.testing.assert_allclose(turn @ turn.T, np.eye(2), atol=1e-12)


def test_metrics(spark, points):
    anchors = spark.createDataFrame([(i, DATA[i].tolist(), (1 + np.abs(DATA[i])).tolist(), 1.0, 0.7) for i in range(12)], "anchor_no int, coords array<double>, g array<double>, weight double, sigma double")
    got = {r["vec_id"]: r["g"] for r in metrics.rbf_metric(points.where("vec_id < 30"), anchors).collect()}
    for i, g in got.items():
        r = np.linalg.norm(DATA[:12] - DATA[i], axis=1)
        at = np.lexsort((np.arange(12), r))[:5]
        w = np.exp(-0.5 * (r[at] / 0.7) ** 2)
        np.testing.assert_allclose(g, (w[:, None] * (1 + np.abs(DATA[at]))).sum(0) / w.sum() if w.sum() > 1e-30 else np.ones(10))
    assert metrics.anchor_sigmas([[0.0], [1.0], [3.0], [10.0]]) == [1.0, 1.0, 3.0, 10.0]


def test_paths(spark):
    rows = [(1, i, [float(i) ** 2 / 10, 0.0]) for i in range(11)] + [(2, i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(11)]
    df = spark.createDataFrame(rows, "path_id int, step int, point array<double>")
    even = {r["step"]: r["point"][0] for r in paths.resample(df, 5).where("path_id = 1").collect()}
    assert even == {i: pytest.approx(2.0 * i, abs=1e-9) for i in range(6)}
    bend = [r["curvature"] for r in paths.curvature(df).where("path_id = 2").collect()]
    assert bend == [pytest.approx(1.0, rel=1e-3)] * 9
    assert all(r["curvature"] == pytest.approx(0) for r in paths.curvature(df).where("path_id = 1").collect())
    e = {r["path_id"]: (r["length"], r["energy"]) for r in paths.energy(df).collect()}
    assert e[1][0] == pytest.approx(10) and e[2][1] == pytest.approx(0.5 * e[2][0] ** 2, rel=1e-9)


def test_store_tables(spark):
    p = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "vec_id long, name string, w double")
    new = spark.createDataFrame([(2, "B", 5.0), (4, "D", 6.0)], p.schema)
    assert sorted(tuple(r) for r in store.upsert(p, new).collect()) == [(1, "a", 1.0), (2, "B", 5.0), (3, "c", 3.0), (4, "D", 6.0)]
    change = spark.createDataFrame([(1, None, 9.0)], p.schema)
    assert sorted(tuple(r) for r in store.update(p, change).collect())[0] == (1, "a", 9.0)
    assert [r["vec_id"] for r in store.get_batch(p, [3, 9, 1]).collect()] == [3, 1]
    assert sorted(r["vec_id"] for r in store.with_new_ids(p, new.drop("vec_id").repartition(3), "vec_id").collect()) == [4, 5]
    assert store.latest(p.union(new), [F.desc("w")]).count() == 4
    ok = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, vector array<double>")
    assert store.validated(ok, 2).count() == 1
    with pytest.raises(Exception, match="bad vector"):
        store.validated(ok, 3).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n# note\n1, 2\n\n% more\n3,4,5\n5,6\nz,1\n")
    assert sorted(r["vector"] for r in files.read_csv(spark, str(tmp_path / "a.csv"), 2).collect()) == [[1.0, 2.0], [5.0, 6.0]]
    (tmp_path / "m.bin").write_bytes(struct.pack("<II6d", 3, 2, *range(6)))
    assert [r["vector"] for r in files.read_binary(spark, str(tmp_path / "m.bin")).orderBy("row").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    np.save(tmp_path / "d.npy", DATA[:5])
    got = files.read_npy(spark, str(tmp_path / "d.npy")).orderBy("row").collect()
    np.testing.assert_array_equal([r["vector"] for r in got], DATA[:5])
    df = spark.createDataFrame([(1, [1.5, -2.0], {"a": 'q"x,'}), (2, None, None)], "vec_id long, vector array<double>, meta map<string,string>")
    for kind in ("csv", "json", "parquet"):
        files.export(df, str(tmp_path / kind), kind)
        back = files.load(spark, str(tmp_path / kind), "vec_id long, vector array<double>, meta map<string,string>", kind)
        assert sorted(back.collect(), key=lambda r: r["vec_id"]) == df.collect()
    files.save_store({"charts": df.limit(1), "points": df}, str(tmp_path / "s"), "vec_id")
    assert files.load_store(spark, str(tmp_path / "s"), ("charts", "points"))["points"].count() == 2
    with pytest.raises(ValueError):
        files.from_numpy(spark, np.zeros((0, 3)))


def test_learning(spark):
    rng = random.Random(1)
    flat = [[rng.random(), rng.random(), 0.0, 0.0] for _ in range(400)]
    p = files.from_numpy(spark, flat)
    near = learning.neighbour_distances(p, 10).cache()
    assert learning.dim_two_nn(near).first()[0] == pytest.approx(2, abs=0.4)
    assert learning.dim_mle(near, 10).first()[0] == pytest.approx(2, abs=0.5)
    assert learning.dim_local_pca(learning.local_pca(p, 12)).first()[0] == 2
    rows = spark.range(50).select(F.col("id").alias("idx"))
    got = sorted((r["patch"], r["idx"]) for r in learning.patches(rows, 10, 0.4).collect())
    assert got == [(k, i) for k in range(7) for i in range(6 * k, 6 * k + 10)]
    assert learning.gap_dimension([5.0, 4.0, 0.1, 0.09]) == 2
    assert learning.quality_score(1, 0, [2.0, 2.0], [1.0]) == pytest.approx(1)


def test_kernels_take_batches():
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0.8, 1.4, (6, 2)), rng.uniform(0.9, 1.6, (6, 2))
    p, q = rng.random((6, 5)), rng.random((6, 5))
    for g in (G.sphere, G.half_plane, G.wells):
        for kernel in (G.geodesic_distance, G.curvature_corrected, G.exp_map):
            np.testing.assert_allclose(kernel(g, a, b - a if kernel is G.exp_map else b), [kernel(g, x, y - x if kernel is G.exp_map else y) for x, y in zip(a, b, strict=True)], rtol=1e-7)
        np.testing.assert_allclose(G.scalar_curvature(g, a), [G.scalar_curvature(g, x) for x in a], rtol=1e-6)
    np.testing.assert_allclose(G.wasserstein2(p, q), [G.wasserstein2(x, y) for x, y in zip(p, q, strict=True)])


def test_batch_udfs_keep_nulls_and_lengths(spark):
    from chartlake.functions import udfs

    rows = spark.createDataFrame([(0, [1.0, 0.2], [1.1, 0.4]), (1, None, [1.0, 0.0]), (2, [1.0, 0.2], [1.0, 0.2])], "id int, a array<double>, b array<double>")
    got = {r["id"]: (r["d"], r["e"]) for r in rows.select("id", udfs.geodesic_distance("sphere", F.col("a"), F.col("b")).alias("d"), udfs.log_map("sphere", F.col("a"), F.col("b")).alias("e")).collect()}
    assert got[1] == (None, None) and got[2] == (0.0, [0.0, 0.0]) and got[0][0] > 0
    mixed = spark.createDataFrame([([1.0, 3.0], [1.0, 3.0]), ([1.0, 1.0, 2.0], [2.0, 1.0, 1.0])], "p array<double>, q array<double>")
    near, far = sorted(r[0] for r in mixed.select(udfs.sinkhorn(F.col("p"), F.col("q"), 0.02)).collect())
    assert near == pytest.approx(0, abs=1e-3) and far == pytest.approx(1 / 6, abs=0.01)


def test_batch_distances_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(40, 3)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, vector array<double>")
    queries = rows.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(search, "BLOCK", 3)
    got = {(r["query_id"], r["vec_id"]): r["distance"] for r in search.batch_distances(rows, queries).collect()}
    assert len(got) == 8 * 40
    assert all(d == pytest.approx(float(np.linalg.norm(x[i] - x[j]))) for (i, j), d in got.items())
    share = np.sqrt(x / x.sum(1, keepdims=True))
    for r in search.knn_batch(rows, queries, 2, "fisher_rao", drop_self=True).where("rank = 1").collect():
        d = 2 * np.arccos(np.clip(share @ share[r["query_id"]], -1, 1))
        d[r["query_id"]] = 9
        assert r["vec_id"] == int(d.argmin()) and r["distance"] == pytest.approx(d.min(), abs=1e-6)
    assert search.batch_distances(rows, queries.limit(0)).count() == 0


def test_chart_ties(spark):
    two = spark.createDataFrame([(1, 0, 0.5, 1), (1, 3, 0.5, 2), (2, 3, 0.1, 1), (2, 0, 1.1, 2), (3, 4, 0.0, 1)], "vec_id int, chart_id int, residual double, rank int")
    assert [(r["i"], r["j"], round(r["w"], 6)) for r in atlas.chart_ties(two).collect()] == [(0, 3, round(1 + float(np.exp(-1.0)), 6))]


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e7])
def test_far_from_the_origin(spark, offset):
    """Exact neighbours and anchors whatever the offset of the data."""
    rng = np.random.default_rng(4)
    data = rng.normal(size=(1500, 8)) + offset
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, vector array<double>")
    d = np.sqrt(((data[:, None, :] - data[None, ::30, :]) ** 2).sum(-1))
    queries = points.where("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in search.knn_batch(points, queries, 7).collect()}
    assert all(got[30 * j, k + 1] == i for j in range(50) for k, i in enumerate(np.lexsort((np.arange(1500), d[:, j]))[:7]))
    anchors = points.where("vec_id % 30 = 0").select(F.col("vec_id").alias("anchor_id"), F.col("vector").alias("base"))
    cells = {r["vec_id"]: r["anchor_id"] for r in search.assign_anchors(points, anchors).collect()}
    assert all(cells[i] == 30 * int(np.argmin(d[i])) for i in range(1500))


def test_batch_neighbours_with_ties_and_names(spark):
    """Many equal rows, names as ids, more queries than a slice and no row of one's own."""
    rng = np.random.default_rng(6)
    data = rng.integers(0, 3, size=(1300, 3)).astype(float)
    points = spark.createDataFrame([(f"n{i:05d}", x.tolist()) for i, x in enumerate(data)] + [("none", None)], "vec_id string, vector array<double>").repartition(3)
    for metric, norm in (("euclidean", lambda x: np.sqrt((x**2).sum(-1))), ("manhattan", lambda x: np.abs(x).sum(-1))):
        near = search.knn_batch(points, points.select(F.col("vec_id").alias("query_id"), "vector"), 4, metric, drop_self=True).collect()
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in near}
        for j in range(0, 1300, 97):
            order = [i for i in np.lexsort((np.arange(1300), norm(data - data[j]))) if i != j][:4]
            assert [got[f"n{j:05d}", k + 1] for k in range(4)] == [f"n{i:05d}" for i in order]


def test_index_recall(spark):
    """With the probes that the measurement asks for, nine in ten true neighbours are found; the bounded search finds all."""
    rng = np.random.default_rng(8)
    data = rng.normal(size=(30, 6))[rng.integers(0, 30, 2000)] * 3 + rng.normal(size=(2000, 6))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, vector array<double>")
    anchors = points.where("vec_id % 50 = 0").select(F.col("vec_id").alias("anchor_id"), F.col("vector").alias("base"))
    assigned, held = search.assign_anchors(points, anchors).cache(), [(r[0], list(r[1])) for r in anchors.collect()]
    measured = search.probe_recall(points, anchors, points.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector"))
    probes = search.probes_for(measured)
    assert probes < 40 and measured.count() == 40
    hits = 0
    for j in range(7, 2000, 200):
        truth = set(np.argsort(np.linalg.norm(data - data[j], axis=1))[:10].tolist())
        assert {r["vec_id"] for r in search.anchor_knn(assigned, held, data[j].tolist(), 10).collect()} == truth
        hits += len(truth & {r["vec_id"] for r in search.anchor_search(assigned, held, data[j].tolist(), 10, probes).collect()})
    assert hits >= 85
    assigned.unpersist()


def test_sides_are_checked_in_bytes(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [[1.0] * 8] * 8) for i in range(4)], "id int, m array<array<double>>")
    assert len(search.small_side(rows)) == 4
    monkeypatch.setattr(search, "MAX_SIDE_BYTES", 1000)
    with pytest.raises(ValueError):
        search.small_side(rows)


def _nearest(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :k]
    return {(i, r + 1): (int(j), d[i, j]) for i in range(len(x)) for r, j in enumerate(order[i]) if np.isfinite(d[i, j])}


@pytest.mark.parametrize("case", ["plain", "far", "two", "copies", "same"])
def test_neighbours_of_all_points(spark, monkeypatch, case):
    """Groups of points instead of blocks of queries: exact, and no more rows than k for each query and group."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6))
    if case == "far":
        x = x + 1e7
    if case == "two":
        x[::2] += 1e6
    if case == "copies":
        x = np.round(x[:, :2] / 2)
    if case == "same":
        x[:400] = 1.0
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * x.shape[1])], "vec_id long, vector array<double>").repartition(16)
    queries = points.select(F.col("vec_id").alias("query_id"), "vector")
    rows, taken = [], search._by_groups
    monkeypatch.setattr(search, "GROUP", 400)
    monkeypatch.setattr(search, "_by_groups", lambda *a: rows.append(taken(*a)) or rows[0])
    got = {(r["query_id"], r["rank"]): (r["vec_id"], pytest.approx(r["distance"], abs=1e-12)) for r in search.knn_batch(points, queries, 5, drop_self=True).collect()}
    assert got == _nearest(x, 5) and len(rows) == 1
    assert rows[0].count() <= 700 * 5 * (1 if case == "copies" else 2)


def test_neighbours_by_name_and_few(spark):
    rows = [(n, [float(i), 0.0]) for i, n in enumerate(["d", "a", "c", "b"])] + [("a", [9.0, 0.0])]  # a name that is there twice
    points = spark.createDataFrame(rows, "vec_id string, vector array<double>")
    queries = points.select(F.col("vec_id").alias("query_id"), "vector")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["distance"]) for r in search.knn_batch(points, queries, 9, drop_self=True).collect()}
    assert {k: v for k, v in got.items() if k[0] == "c"} == {("c", 1): ("a", 1.0), ("c", 2): ("b", 1.0), ("c", 3): ("d", 2.0), ("c", 4): ("a", 7.0)}
    assert [got["a", r] for r in (1, 2, 3)] == [("c", 1.0), ("d", 1.0), ("b", 2.0)]
    assert search.knn_batch(points.where("false"), queries, 3).collect() == []


def test_mle_searches_once(points):
    near = learning.neighbour_distances(points, 5)
    out = learning.dim_mle(near, 5)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    by: dict = {}
    for r in near.collect():
        by.setdefault(r["query_id"], {})[r["rank"]] = r["distance"]
    assert out.first()["dim"] == pytest.approx(1 / np.mean([math.log(d[5] / d[j]) for d in by.values() for j in range(1, 5)]))
