"""Communities and diffusion maps of point graphs against the same on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartlake.operators import atlas, learning, search, spectral


@pytest.fixture(scope="module")
def blobs(spark):
    """60 groups of 8 close points along a spiral: more groups than the 40 regions of an earlier version."""
    rng = np.random.default_rng(3)
    t = np.repeat(np.arange(60), 8)
    centre = np.stack([np.cos(t * 0.4), np.sin(t * 0.4), t * 0.2], 1) * 5
    rows = [(i, x.tolist()) for i, x in enumerate(centre + rng.normal(scale=0.05, size=centre.shape))]
    return spark.createDataFrame(rows, "vec_id long, vector array<double>")


def test_louvain_tells_more_groups_than_regions(blobs):
    graph = atlas.knn_graph(blobs, 5)
    got = {r["id"]: r["community"] for r in spectral.louvain(graph).collect()}
    assert len(set(got.values())) == 60 and all(len({got[8 * g + k] for k in range(8)}) == 1 for g in range(60))


def test_small_communities_go_to_the_nearest_centroid(spark):
    points = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate([0, 0, 0, 9, 9, 9, 8])], "vec_id long, vector array<double>")
    member = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3), (6, 6)], "id long, community long")
    got = {r["id"]: r["merged"] for r in spectral.merge_small(points, member, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 3}


def test_diffusion_map_equals_the_dense_one(spark):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(150, 3)) * [3, 1.5, 0.5])], "vec_id long, vector array<double>")
    graph = atlas.knn_graph(points, 8).cache()
    want = learning.spectral_map([tuple(r) for r in graph.select("i", "j", "w").collect()])
    got = {r["id"]: r["coordinates"] for r in spectral.diffusion_coordinates(graph).collect()}
    g, w = (np.array([x[i] for i in range(150)]) for x in (got, want))
    for c in range(2):
        assert min(np.abs(g[:, c] - w[:, c]).max(), np.abs(g[:, c] + w[:, c]).max()) < 1e-4 * np.abs(w).max()


def test_held_vectors_equal_tables(spark, monkeypatch):
    """Vectors that the driver holds give the coordinates that the tables give, with far fewer jobs."""
    rng = np.random.default_rng(3)
    pairs = {(i, i + 1) for i in range(59)} | {(int(a), int(b)) for a, b in rng.integers(0, 60, (90, 2)) if a < b}
    edges = spark.createDataFrame([(f"n{x:02d}", f"n{y:02d}", 1.0 + (a * b) % 3) for a, b in sorted(pairs) for x, y in ((a, b), (b, a))], "i string, j string, w double")
    edges = edges.select(F.substring("i", 2, 2).cast("long").alias("i"), F.substring("j", 2, 2).cast("long").alias("j"), "w")
    made, keep = [], spectral.checkpointed
    monkeypatch.setattr(spectral, "checkpointed", lambda df: made.append(1) or keep(df))
    monkeypatch.setattr(spectral, "EDGES", 64)
    held = {r["id"]: r["coordinates"] for r in spectral.diffusion_coordinates(edges).collect()}
    assert len(made) <= 6
    monkeypatch.setattr(search, "MAX_SIDE_BYTES", 1000)
    tables = {r["id"]: r["coordinates"] for r in spectral.diffusion_coordinates(edges).collect()}
    assert held.keys() == tables.keys()
    np.testing.assert_allclose([held[i] for i in sorted(held)], [tables[i] for i in sorted(held)], atol=1e-4)
