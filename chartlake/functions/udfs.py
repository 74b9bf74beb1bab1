"""Arrow-batched wrappers of the numpy kernels, for what Column expressions cannot say."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from . import vectors as V


def _vectorised(kernel, returns: str, arity: int = 2):
    """A UDF that calls the kernel once per Arrow batch and row length, on (rows, n) arrays; null rows give null."""

    def run(*columns: pd.Series) -> pd.Series:
        alike: dict[tuple, list[int]] = {}
        for i, row in enumerate(zip(*columns, strict=True)):
            if all(x is not None for x in row):
                alike.setdefault(tuple(map(len, row)), []).append(i)
        out: list = [None] * len(columns[0])
        for at in alike.values():
            found = kernel(*(np.array(c.iloc[at].tolist(), float) for c in columns))
            for i, value in zip(at, found.reshape(len(at), -1).tolist() if returns.startswith("array") else found.tolist(), strict=True):
                out[i] = value
        return pd.Series(out, dtype=object if returns.startswith("array") else float)

    if arity == 1:

        @F.pandas_udf(returns)
        def one(a: pd.Series) -> pd.Series:
            return run(a)

        return one
    if arity == 3:

        @F.pandas_udf(returns)
        def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return run(a, b, c)

        return three

    @F.pandas_udf(returns)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return two


def geodesic_distance(metric: str, a: Column, b: Column) -> Column:
    return _vectorised(partial(G.geodesic_distance, G.METRICS[metric]), "double")(a, b)


def chord(metric: str, a: Column, b: Column) -> Column:
    return _vectorised(partial(G.chord, G.METRICS[metric]), "double")(a, b)


def geodesic_path(metric: str, a: Column, b: Column, steps: int) -> Column:
    """The points of the path one after another."""
    return _vectorised(lambda x, y: G.geodesic_path(G.METRICS[metric], x, y, steps).reshape(len(x), -1), "array<double>")(a, b)


def exp_adaptive(metric: str, point: Column, velocity: Column) -> Column:
    """End of the geodesic by adaptive steps, then its arc length."""

    def run(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        end, _, arc = G.solve_adaptive(G.METRICS[metric], x, v)
        return np.concatenate([end, arc[:, None]], axis=1)

    return _vectorised(run, "array<double>")(point, velocity)


def mean_curvature(metric: str, point: Column) -> Column:
    return _vectorised(lambda x: np.array([G.mean_curvature(G.METRICS[metric], p) for p in x]), "array<double>", 1)(point)


def named(metric: str):
    """The distance of that name for two columns: 'geodesic:sphere', 'curvature:sphere', 'chord:sphere' (any metric of
    geometry.METRICS), 'wasserstein' (weights on a line), 'log_euclidean' (square matrices as flattened rows), or a
    closed form of vectors.METRICS."""
    kind, _, space = metric.partition(":")
    curved = {"geodesic": geodesic_distance, "curvature": curvature_corrected, "chord": chord}
    if space:
        if kind not in curved or space not in G.METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        return lambda a, b: curved[kind](space, a, b)
    if metric == "wasserstein":
        return wasserstein
    if metric == "log_euclidean":

        def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            dim = int(round(x.shape[1] ** 0.5))
            return np.array([G.log_euclidean(m.reshape(dim, dim), n.reshape(dim, dim)) for m, n in zip(x, y, strict=True)])

        return _vectorised(distance, "double")
    return V.distance(metric)


def curvature_corrected(metric: str, a: Column, b: Column) -> Column:
    return _vectorised(partial(G.curvature_corrected, G.METRICS[metric]), "double")(a, b)


def exp_map(metric: str, point: Column, velocity: Column, steps: int = 50) -> Column:
    return _vectorised(partial(G.exp_map, G.METRICS[metric], steps=steps), "array<double>")(point, velocity)


def log_map(metric: str, a: Column, b: Column) -> Column:
    g = G.METRICS[metric]
    return _vectorised(lambda x, y: G.log_map(g, x, y)[0], "array<double>")(a, b)


def acceleration(metric: str, point: Column, velocity: Column) -> Column:
    """Coordinate acceleration of the geodesic through the point."""
    return _vectorised(partial(G.acceleration, G.METRICS[metric]), "array<double>")(point, velocity)


def christoffel(metric: str, point: Column) -> Column:
    """Flattened row by row."""
    return _vectorised(partial(G.christoffel, G.METRICS[metric]), "array<double>", 1)(point)


def scalar_curvature(metric: str, point: Column) -> Column:
    return _vectorised(partial(G.scalar_curvature, G.METRICS[metric]), "double", 1)(point)


def sinkhorn(p: Column, q: Column, reg: float = 0.1) -> Column:
    """Optimal transport cost under |i - j| / n between the entries."""

    def cost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.arange(x.shape[-1])
        return G.sinkhorn(x, y, np.abs(at[:, None] - at[None, :]) / len(at), reg)

    return _vectorised(cost, "double")(p, q)


def wasserstein(p: Column, q: Column) -> Column:
    return _vectorised(G.wasserstein2, "double")(p, q)


def log_euclidean(a: Column, b: Column, dim: int) -> Column:
    """Distance of two SPD matrices given as flattened rows."""

    def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.array([G.log_euclidean(m.reshape(dim, dim), n.reshape(dim, dim)) for m, n in zip(x, y, strict=True)])

    return _vectorised(distance, "double")(a, b)


def transported(metric: str, a: Column, b: Column, vector: Column, steps: int = 4) -> Column:
    """vector carried along the straight coordinate line from a to b."""
    g = G.METRICS[metric]
    return _vectorised(lambda x, y, v: G.parallel_transport(g, np.linspace(x, y, steps + 1), v), "array<double>", 3)(a, b, vector)


def exp_orthonormal(metric: str, point: Column, velocity: Column) -> Column:
    """exp_map of a velocity given in a frame that is orthonormal at the point."""
    return _vectorised(partial(G.exp_orthonormal, G.METRICS[metric]), "array<double>")(point, velocity)
