"""Tangent spaces, boxes, ball samples, the registry and the kernels added with them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartlake.functions import geometry as G
from chartlake.functions import vectors as V
from chartlake.operators import atlas, metrics, paths, store, tangent


def _plane(n, seed=1):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.normal(size=(n, 2)) * [2.0, 1.0], np.zeros(n)])


def test_spaces_find_the_plane(spark):
    x = _plane(60)
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(99, 0, None)], "vec_id long, anchor_id long, vector array<double>")
    spaces = tangent.tangent_spaces(rows, {0: [0.0] * 3, 1: [0.0] * 3, 2: [0.0] * 3}, 3)
    assert [s[0] for s in spaces] == [0, 1] and all(len(s[2]) == 2 for s in spaces)
    for key, _, basis, metric in spaces:
        own = x[key::2]
        values, axes = np.linalg.eigh(own.T @ own)
        np.testing.assert_allclose(np.abs(np.array(basis) @ axes[:, ::-1][:, :2]), np.eye(2), atol=1e-9)
        assert np.linalg.eigvalsh(np.array(metric)).min() >= 1
    assert tangent.tangent_spaces(rows.limit(0), {}, 3) == []
    with pytest.raises(ValueError):
        tangent.tangent_spaces(rows, dict.fromkeys(range(tangent.MAX_SPACES + 1), [0.0] * 3), 3)


def test_log_exp_and_carrying(spark):
    base, basis = [1.0, 0.0, 0.0], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    row = spark.range(1).select(tangent.log_at(V.literal([1.3, 0.4, 0.0]), V.literal(base), V.matrix_literal(basis), 3).alias("l"), tangent.exp_at(V.literal([0.3, 0.4]), V.literal(base), V.matrix_literal(basis)).alias("e")).first()
    assert row["l"] == pytest.approx([x * (1 - 0.25 / 96) for x in (0.3, 0.4)]) and row["e"] == pytest.approx([1.3, 0.4, 0.0])
    a = (0, base, basis, np.eye(2).tolist())
    b = (1, base, [[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]], (4 * np.eye(2)).tolist())
    v = tangent.carried(a, b, np.array([1.0, 0.0]))
    assert v == pytest.approx([0.0, -0.5])  # length 1 under both metrics


def test_updated_and_blended_bases():
    x = _plane(200)
    tilted = x @ np.array([[1, 0, 0.2], [0, 1, 0], [0, 0, 1.0]])
    space = (0, [0.0] * 3, [[1.0, 0, 0], [0, 1.0, 0]], np.eye(2).tolist())
    mean, sums = tilted.mean(0), tilted.T @ tilted
    same, turned = tangent.updated_basis(space, 0, mean, sums), np.array(tangent.updated_basis(space, 200, mean, sums, 1.0)[2])
    assert same == space
    assert np.abs(tilted - tilted @ turned.T @ turned).max() < 1e-9
    half = np.array(tangent.updated_basis(space, 200, mean, sums, 0.5)[2])
    np.testing.assert_allclose(half @ half.T, np.eye(2), atol=1e-12)
    flipped = (1, [2.0, 0, 0], [[-1.0, 0, 0], [0, -1.0, 0]], np.eye(2).tolist())
    base, basis = tangent.blended_space([space, flipped], np.array([1.0, 0, 0]), 2)
    assert base == pytest.approx([1.0, 0, 0]) and np.abs(basis) == pytest.approx(np.eye(3)[:2])
    with pytest.raises(ValueError):
        tangent.blended_space([], np.zeros(3))


def test_boxes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3)) + np.repeat(np.eye(4, 3) * 8, 20, axis=0)
    rows = spark.createDataFrame([(i, i // 20, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, vector array<double>")
    boxes = atlas.bounds(rows, "label", 3)
    for q in (x[5], x[45], np.full(3, 3.0)):
        want = {i for i in range(80) if np.linalg.norm(x[i] - q) <= 2.5}
        assert {r["vec_id"] for r in tangent.pruned_ball(rows, boxes, q.tolist(), 2.5, "label").collect()} == want
    near = boxes.select("label", tangent.box_distance(V.literal(x[5].tolist()), F.col("lo"), F.col("hi")).alias("d")).collect()
    for r in near:
        assert r["d"] <= np.linalg.norm(x[20 * r["label"] : 20 * r["label"] + 20] - x[5], axis=1).min() + 1e-12
    unit = [V.literal(v) for v in ([0.0, 0.0], [1.0, 1.0], [1.0, 0.5], [2.0, 2.0], [1.5, 0.0])]
    assert tuple(spark.range(1).select(tangent.boxes_meet(unit[0], unit[1], unit[2], unit[3]), tangent.boxes_meet(unit[0], unit[1], unit[4], unit[3])).first()) == (True, False)


def test_ball_samples_lie_in_the_ball(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.3]), (2, None)], "vec_id long, point array<double>")
    got = tangent.ball_samples(rows, "sphere", 0.5, 300, 2).orderBy("sample").collect()
    assert len(got) == 300 and got == tangent.ball_samples(rows, "sphere", 0.5, 300, 2).orderBy("sample").collect()
    p = np.array([r["point"] for r in got])
    arc = np.arccos(np.clip(np.cos(1.0) * np.cos(p[:, 0]) + np.sin(1.0) * np.sin(p[:, 0]) * np.cos(p[:, 1] - 0.3), -1, 1))
    assert arc.max() <= 0.5 + 1e-6 and np.mean(arc < 0.5 / np.sqrt(2)) == pytest.approx(0.5, abs=0.1)


def test_registry(spark):
    basis = [[1.0, 0.0], [0.0, 1.0]]
    r = tangent.Registry([(i, [0.0, 0.0], basis) for i in range(4)], [(0, 1, basis, [1.0, 0.0]), (1, 2, basis, [0.0, 2.0])])
    m, b = r.chain(0, 2)
    assert b.tolist() == [1.0, 2.0] and m.tolist() == basis and r.isolated() == [3]
    again = tangent.Registry.from_tables(r.tables(spark))
    assert again.summary() == r.summary() and again.chart(2)[0] == 2
    for wrong in (lambda: r.add_chart((0, [0.0, 0.0], basis)), lambda: r.add_transition((0, 1, basis, [1.0]))):
        with pytest.raises(ValueError):
            wrong()
    for missing in (lambda: r.chart(9), lambda: r.add_transition((0, 9, basis, [0.0, 0.0])), lambda: r.chain(0, 3), lambda: r.transition(2, 0)):
        with pytest.raises(KeyError):
            missing()
    r.remove_chart(1)
    assert r.isolated() == [0, 2, 3] and not r.transitions


def test_induced_metric_and_time_transport():
    def embed(x):
        return np.stack([np.sin(x[..., 0]) * np.cos(x[..., 1]), np.sin(x[..., 0]) * np.sin(x[..., 1]), np.cos(x[..., 0])], axis=-1)

    at = np.array([[0.9, 0.2], [1.3, -0.4]])
    np.testing.assert_allclose(G.induced(embed)(at), G.sphere(at), atol=1e-8)
    np.testing.assert_allclose(G.christoffel(G.induced(embed, 1e-4), at[0], 1e-4), G.christoffel(G.sphere, at[0]), atol=1e-5)
    times, curve, v = np.array([0.0, 1.0, 2.0]), np.array([[1.0, 0.0], [1.2, 0.3], [1.1, 0.8]]), np.array([0.3, 0.4])
    out = G.transport_in_time(G.sphere, times, curve, 0.0, 2.0, v)
    assert G.length(G.sphere, curve[-1], out) == pytest.approx(G.length(G.sphere, curve[0], v), rel=1e-5)
    assert G.transport_in_time(G.flat, times, curve, 0.0, 2.0, v) == pytest.approx(v)
    assert G.transport_in_time(G.sphere, times[:0], curve[:0], 0, 1, v) == pytest.approx(v)
    w = G.wasserstein_metric(np.array([[2.0, 0.0], [0.0, 8.0]]), np.array([1.0, 3.0]))
    np.testing.assert_allclose(w, np.diag([0.125, 0.75 / 8]))


def test_pruned_knn_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3)) + 6 * np.repeat(rng.normal(size=(6, 3)), 20, axis=0)
    x[7] = x[3]  # a tie
    data = [(i, None if i // 20 == 5 else i // 20, v.tolist()) for i, v in enumerate(x)] + [(500, 1, None), (501, 9, None)]
    rows = spark.createDataFrame(data, "vec_id long, kind int, vector array<double>")
    boxes = atlas.bounds(rows, "kind", 3, members=True)
    for at, k in ((3, 1), (110, 7), (0, 25), (50, 500)):
        distance = np.linalg.norm(x - x[at], axis=1)
        want = sorted(range(120), key=lambda i: (distance[i], i))[:k]
        got = tangent.pruned_knn(rows, boxes, x[at].tolist(), k, "kind").orderBy("distance", "vec_id").collect()
        assert [r["vec_id"] for r in got] == want
    assert tangent.pruned_knn(rows.where("false"), boxes.where("false"), [0.0] * 3, 2, "kind").collect() == []
    near = tangent.pruned_ball(rows, boxes, x[110].tolist(), 1.5, "kind").collect()
    assert {r["vec_id"] for r in near} == set(np.flatnonzero(np.linalg.norm(x - x[110], axis=1) <= 1.5).tolist())
    with pytest.raises(ValueError):
        tangent.pruned_knn(rows, boxes, [0.0] * 3, 0, "kind")


def test_ids_by_modality(spark):
    held = spark.createDataFrame([(4, "a"), (9, None), (2, "b")], "point_id long, modality string")
    new = spark.createDataFrame([(i, m) for i, m in enumerate(["a", None, "c", "a", "c", None, "a"])], "seq int, modality string").repartition(3)
    got = {r["seq"]: r["point_id"] for r in store.with_modality_ids(held, new, [F.col("seq")]).collect()}
    assert got == {0: 5, 3: 6, 6: 7, 1: 10, 5: 11, 2: 0, 4: 1}
    assert {r["point_id"] for r in store.with_modality_ids(held.where("false"), new.where("seq = 0"), [F.col("seq")]).collect()} == {0}
    assert store.with_modality_ids(held, new.where("false"), [F.col("seq")]).collect() == []


def test_stored_metrics_indices_and_lengths(spark):
    rows = spark.createDataFrame([(1, "a", [3.0, 4.0]), (2, None, [0.0, 0.0]), (3, "z", None)], "vec_id long, chart string, vector array<double>")
    g = [[2.0, 1.0], [1.0, 3.0]]
    held = spark.createDataFrame([("a", g)], "chart string, g array<array<double>>")
    got = {r["vec_id"]: r["g"] for r in metrics.evaluate(rows, held, 2).collect()}
    assert got == {1: g, 2: [[1.0, 0.0], [0.0, 1.0]], 3: [[1.0, 0.0], [0.0, 1.0]]}
    with pytest.raises(ValueError):
        metrics.evaluate(rows, held.unionAll(held), 2)
    low = rows.select("vec_id", metrics.lowered(F.col("vector"), g).alias("low"))
    assert low.first()["low"] == [10.0, 15.0]
    np.testing.assert_allclose(low.select(metrics.raised(F.col("low"), g).alias("up")).first()["up"], [3.0, 4.0])
    sized = [r[0] for r in rows.select(paths.with_length_of(F.array(F.lit(0.0), F.lit(2.0)), F.col("vector"))).collect()]
    assert sized[:2] == [[0.0, 5.0], [0.0, 0.0]] and sized[2] is None
    still = rows.select(paths.with_length_of(F.array(F.lit(0.0), F.lit(0.0)), F.col("vector"))).first()[0]
    assert still == [0.0, 0.0]


def test_overlap_boxes(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [10.0, 3.0]), (3, None), (4, [5.0, 5.0])], "vec_id long, vector array<double>")
    shared = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (0, 1, 3), (1, 2, 3), (2, 3, 4)], "chart_a int, chart_b int, vec_id long")
    got = {(r["chart_a"], r["chart_b"]): (r["n"], r["lo"], r["hi"]) for r in atlas.overlap_boxes(shared, rows, 2, 0.1).collect()}
    assert got == {(0, 1): (2, [-1.0, 0.8], [11.0, 3.2]), (1, 2): (0, [None, None], [None, None]), (2, 3): (1, [5.0, 5.0], [5.0, 5.0])}
    assert atlas.overlap_boxes(shared.where("false"), rows, 2).collect() == []
