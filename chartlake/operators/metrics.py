"""Metric fields: kernels, anchor interpolation, diagonal metrics and statistics of scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import search


def gaussian(r: Column, sigma: Column) -> Column:
    return F.exp(-0.5 * (r / sigma) * (r / sigma))


def thin_plate(r: Column, sigma: Column) -> Column:
    s = r / sigma
    return F.when(s > 0, s * s * F.log(s)).otherwise(F.lit(0.0))


def inverse_quadratic(r: Column, sigma: Column) -> Column:
    return 1.0 / (1.0 + (r / sigma) * (r / sigma))


def rbf_metric(points: DataFrame, anchors: DataFrame, near: int = 5, id_col: str = "vec_id", vec: str = "vector", full: bool = False) -> DataFrame:
    """(id, g): the metric interpolated from the nearest anchors (anchor_no, coords, g, weight, sigma); no shuffle.

    g is a diagonal, or with full a matrix as flattened rows. Weights are weight * exp(-(r / sigma)^2 / 2); where they
    sum to at most 1e-30, or without anchors, the metric is the identity.
    """
    held = sorted(search.small_side(anchors.select("anchor_no", "coords", "g", "weight", "sigma")), key=lambda r: r["anchor_no"])
    rows = points.where(F.col(vec).isNotNull()).select(id_col, vec)
    if not held:
        n = F.size(vec)
        cells = F.sequence(F.lit(0), (n * n if full else n) - 1)
        return rows.select(id_col, F.transform(cells, lambda i: F.when((i % (n + 1) == 0) if full else F.lit(True), 1.0).otherwise(0.0)).alias("g"))
    arrays = [np.array([r[c] for r in held], float) for c in ("coords", "g", "weight", "sigma")]
    sent, near = points.sparkSession.sparkContext.broadcast(arrays), min(near, len(held))

    def run(batches):
        coords, g, weight, sigma = sent.value
        one = np.eye(coords.shape[1]).ravel() if full else np.ones(g.shape[1])
        size = max(1, 4_000_000 // coords.size)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = np.array(part.column(1).to_pylist(), float)
                r = np.sqrt(((x[:, None, :] - coords[None, :, :]) ** 2).sum(-1))
                close = np.argsort(r, axis=1, kind="stable")[:, :near]  # ties: the lower anchor
                w = weight[close] * np.exp(-0.5 * (np.take_along_axis(r, close, 1) / sigma[close]) ** 2)
                total = w.sum(1, keepdims=True)
                out = np.where(total > 1e-30, (w[:, :, None] * g[close]).sum(1) / np.maximum(total, 1e-300), one[None, :])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out.tolist(), pa.list_(pa.float64()))], [id_col, "g"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_col} {kind}, g array<double>")


def anchor_sigmas(coords: Sequence[Sequence[float]], nth: int = 3, floor: float = 1e-6) -> list[float]:
    """Bandwidth of each anchor on insertion: distance to its nth nearest predecessor; the first has 1."""
    out = []
    for i, x in enumerate(coords):
        gaps = sorted(math.dist(x, y) for y in coords[:i])
        out.append(max(floor, gaps[min(nth, len(gaps)) - 1]) if gaps else 1.0)
    return out


def diagonal_terms(weights: Column) -> tuple[Column, Column, Column, Column]:
    """g^-1, det, log det and volume element of a diagonal metric; weights are at least 1e-12."""
    safe = F.transform(weights, lambda w: F.greatest(w, F.lit(1e-12)))
    inverse = F.transform(safe, lambda w: 1.0 / w)
    logdet = V.total(F.transform(safe, lambda w: F.log(w)))
    return inverse, F.exp(logdet), logdet, F.exp(0.5 * logdet)


def evaluate(points: DataFrame, store: DataFrame, dim: int, by: str = "chart") -> DataFrame:
    """points with the metric g of their chart (store: chart, g as rows), the identity where none is registered.

    The store is a checked side and a broadcast; two metrics for one chart are an error.
    """
    twice = store.groupBy(by).count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"two metrics for {twice[0][0]}")
    held = search.checked(store.select(F.col(by).alias("__chart"), F.col("g").alias("__g")))
    joined = points.join(held, F.col(by) == F.col("__chart"), "left")
    return joined.withColumn("g", F.coalesce("__g", V.matrix_literal(np.eye(dim).tolist()))).drop("__chart", "__g")


def lowered(v: Column, g: Sequence[Sequence[float]]) -> Column:
    """The covector g v."""
    return V.matvec(V.matrix_literal(g), v)


def raised(w: Column, g: Sequence[Sequence[float]]) -> Column:
    """The vector g^-1 w; a singular metric has a pseudo-inverse."""
    return V.matvec(V.matrix_literal(np.linalg.pinv(np.array(g, float), hermitian=True).tolist()), w)


def score_outer(points: DataFrame, dim: int, vec: str = "vector") -> DataFrame:
    """(i, j, value): mean of x_i x_j, the empirical Fisher matrix of score samples."""
    cells = [F.avg(F.get(F.col(vec), F.lit(i)) * F.get(F.col(vec), F.lit(j))) for i in range(dim) for j in range(dim)]
    one = points.agg(F.array(*cells).alias("m"))
    rows = one.select(F.posexplode("m").alias("p", "value"))
    return rows.select(F.floor(F.col("p") / dim).cast("int").alias("i"), (F.col("p") % dim).cast("int").alias("j"), "value")


def conformal_factor(geodesic: Column, chord: Column) -> Column:
    """Ratio clamped to [0.01, 100]; 1 where the chord is tiny."""
    return F.when(chord < 1e-12, F.lit(1.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.01), geodesic / chord)))


def frobenius(a: Column, b: Column) -> Column:
    """Distance of two matrices given as flattened rows; infinite if one is missing."""
    return F.coalesce(V.euclidean(a, b), F.lit(float("inf")))


def local_metric(rows: np.ndarray, g: np.ndarray, keep: float = 0.7) -> np.ndarray:
    """keep * g + (1 - keep) * L cov L' of neighbour offsets, L being the Cholesky factor of g."""
    factor = np.linalg.cholesky(g)
    return keep * g + (1 - keep) * factor @ np.cov(rows, rowvar=False, bias=True) @ factor.T


def spd_report(metrics: DataFrame, dim: int, col: str = "g") -> DataFrame:
    """Number of metrics, how many are symmetric positive definite, and the largest condition number."""
    @F.pandas_udf("struct<ok:boolean,condition:double>")
    def look(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            m = np.array(v, float).reshape(dim, dim)
            e = np.linalg.eigvalsh((m + m.T) / 2)
            good = bool(np.allclose(m, m.T, atol=1e-9) and e[0] > 0)
            out.append((good, float(e[-1] / e[0]) if good else None))
        return pd.DataFrame(out, columns=["ok", "condition"])

    return metrics.select(look(F.col(col)).alias("r")).agg(F.count("*").alias("n"), F.sum(F.col("r.ok").cast("int")).alias("n_spd"), F.max("r.condition").alias("condition"))
