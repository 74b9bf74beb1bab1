"""Diagnostics and manifold learning: intrinsic dimension, local PCA, patches, spectral maps, latency summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from . import search
from .lineage import numbered


def neighbour_distances(points: DataFrame, k: int, id_col: str = "vec_id", vec: str = "vector") -> DataFrame:
    """(query_id, rank, id, distance) of every point's k nearest others."""
    return search.knn_batch(points, points.select(F.col(id_col).alias("query_id"), vec), k, "euclidean", id_col, vec, drop_self=True)


def dim_two_nn(near: DataFrame) -> DataFrame:
    """1 / mean ln(r2 / r1) over points with r1 > 0."""
    one = near.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("r2"))
    return one.where("r1 > 0").agg((1.0 / F.avg(F.log(F.col("r2") / F.col("r1")))).alias("dim"))


def dim_mle(near: DataFrame, k: int) -> DataFrame:
    """Inverse of the mean of ln(T_k / T_j), j < k, over all points."""
    # a window, as the two sides of a join would each be searched for
    last = F.max(F.when(F.col("rank") == k, F.col("distance"))).over(Window.partitionBy("query_id"))
    rows = near.withColumn("tk", last).where((F.col("rank") < k) & (F.col("distance") > 0))
    return rows.agg((1.0 / F.avg(F.log(F.col("tk") / F.col("distance")))).alias("dim"))


def correlation_dimension(distances: DataFrame, radii: list[float]) -> DataFrame:
    """Slope of ln C(r) against ln r, C(r) being the share of pair distances below r."""
    grid = distances.agg(F.count("*").alias("n"), *[F.sum((F.col("distance") < r).cast("long")).alias(f"c{i}") for i, r in enumerate(radii)])
    rows = grid.select("n", F.explode(F.array(*[F.struct(F.lit(float(r)).alias("r"), F.col(f"c{i}").alias("c")) for i, r in enumerate(radii)])).alias("x"))
    rows = rows.select(F.log("x.r").alias("lr"), F.log(F.col("x.c") / F.col("n")).alias("lc")).where("lc is not null")
    return rows.agg(F.regr_slope("lc", "lr").alias("dim"))


def patches(rows: DataFrame, size: int, overlap: float, index: str = "idx") -> DataFrame:
    """(patch, idx): full windows of `size` row indices, each starting max(1, floor(size (1 - overlap))) further on."""
    step = max(1, int(size * (1 - overlap)))
    n = rows.agg(F.max(index)).first()[0]
    n = 0 if n is None else n + 1
    last = (n - size) // step if n >= size else -1
    low = F.greatest(F.lit(0), F.floor((F.col(index) - size) / F.lit(step)) + 1)
    high = F.least(F.lit(last), F.floor(F.col(index) / F.lit(step)))
    return rows.where(low <= high).select(F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("patch"), index)


def nn_statistics(near: DataFrame) -> DataFrame:
    first = near.where("rank = 1")
    return first.agg(F.count("*").alias("n"), F.avg("distance").alias("mean_d"), F.percentile("distance", 0.5).alias("median_d"), F.stddev_pop("distance").alias("std_d"))


def latency_summary(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """Per kind: count, sum, mean, median, p95 and p99 = sorted[floor(share * n)], min, max and rows per unit of time."""
    placed = numbered(rows.where(F.col(value).isNotNull()).select(kind, value), kind, [F.col(value)])
    v, r, n = F.col(value), F.col("r"), F.col("r_of")

    def at(share: float) -> Column:
        return F.max(F.when(r == F.least(F.floor(n * share), n - 1), v))

    middle = (F.max(F.when(r == F.floor((n - 1) / 2), v)) + F.max(F.when(r == F.ceil((n - 1) / 2), v))) / 2
    return placed.groupBy(kind).agg(
        F.count("*").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), middle.alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.min(v).alias("least"), F.max(v).alias("most"), (F.count("*") / F.sum(v)).alias("rate")
    )


def local_pca(points: DataFrame, k: int = 20, id_col: str = "vec_id", vec: str = "vector") -> DataFrame:
    """(query_id, mean, eigenvalues, residual share beyond the first two) of every point's neighbourhood."""
    near = neighbour_distances(points, k, id_col, vec).select("query_id", id_col).join(points.select(id_col, vec), id_col)

    # a point has k neighbours, so the groups are small; batches of them go through one matrix call
    local = near.groupBy("query_id").agg(F.collect_list(vec).alias("x"))
    kind = points.schema[id_col].dataType.simpleString()

    def fit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for rows in part.column(1).to_pylist():
                    x = np.array(rows, float)
                    values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / len(x)
                    values = np.concatenate([values, np.zeros(max(0, x.shape[1] - len(values)))])
                    out.append((x.mean(0).tolist(), values.tolist(), float(values[2:].sum() / max(values.sum(), 1e-300))))
                if out:
                    mean, values, rest = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mean, pa.list_(pa.float64())), pa.array(values, pa.list_(pa.float64())), pa.array(rest, pa.float64())], ["query_id", "mean", "eigenvalues", "rest"])

    return local.mapInArrow(fit, f"query_id {kind}, mean array<double>, eigenvalues array<double>, rest double")


def dim_local_pca(local: DataFrame, share: float = 0.95) -> DataFrame:
    """Median over points of the least number of axes that explain the share of the local variance."""
    total = V.total(F.col("eigenvalues"))
    sums = F.transform(F.sequence(F.lit(1), F.size("eigenvalues")), lambda n: V.total(F.slice("eigenvalues", F.lit(1), n)))
    need = F.size(F.filter(sums, lambda s: s < share * total)) + 1
    return local.select(need.alias("d")).agg(F.percentile("d", 0.5).alias("dim"))


def gap_dimension(singular: list[float]) -> int:
    """The number of axes before the largest drop (least ratio of neighbouring singular values)."""
    ratios = [b / a if a > 0 else 1.0 for a, b in zip(singular, singular[1:], strict=False)]
    return 1 + min(range(len(ratios)), key=lambda i: (ratios[i], i)) if ratios else len(singular)


def spectral_map(edges: list[tuple], dims: int = 2, alpha: float = 0.5) -> dict:
    """Diffusion map of a bounded graph held by the driver (anchors or a sample): node -> coordinates."""
    nodes = sorted({v for i, j, _ in edges for v in (i, j)})
    at = {v: n for n, v in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for i, j, x in edges:
        w[at[i], at[j]] = w[at[j], at[i]] = x
    d = w.sum(1).clip(1e-300) ** alpha
    w = w / d[:, None] / d[None, :]
    root = np.sqrt(w.sum(1).clip(1e-300))
    values, vectors = np.linalg.eigh(w / root[:, None] / root[None, :])
    axes = (vectors[:, ::-1] / root[:, None])[:, 1 : dims + 1] * values[::-1][1 : dims + 1]
    from ..functions.geometry import fixed_signs

    axes = fixed_signs(axes.T).T
    return {v: axes[n].tolist() for v, n in at.items()}


def quality_score(coverage: float, residual: float, dims: list[float], jaccards: list[float]) -> float:
    """Weights .25, .25, .2, .3 for coverage, 1 - residual, 1 - relative spread of dimensions, mean overlap."""
    spread = float(np.std(dims) / np.mean(dims)) if len(dims) and np.mean(dims) else 0.0
    overlap = float(np.mean(jaccards)) if jaccards else 0.0
    return 0.25 * coverage + 0.25 * (1 - residual) + 0.2 * max(0.0, 1 - spread) + 0.3 * overlap
