"""Search and paths under curved metrics, index upkeep and schema evolution.

The exact geodesic distance is a boundary-value problem; it is solved in Arrow batches and only for candidates that the
chord (the straight coordinate segment under the metric at its middle, a closed form) leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions import vectors as V
from . import atlas, search


def knn(points: DataFrame, query: Sequence[float], k: int, metric: str, oversample: int | None = None, max_distance: float | None = None, chart: tuple[str, object] | None = None, id_col: str = "vec_id", vec: str = "vector") -> DataFrame:
    """Top k by geodesic distance among the closest max(3k, 50) by chord, then those within max_distance.

    chart: (column, value) restricts the search to the points of the query's chart, as its coordinates are local.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = points if chart is None else points.where(F.col(chart[0]) == F.lit(chart[1]))
    q = V.literal(query)
    near = search.top_k(rows.where(F.col(vec).isNotNull()).withColumn("chord", udfs.chord(metric, F.col(vec), q)), oversample or max(3 * k, 50), "chord", id_col)
    found = search.top_k(near.withColumn("distance", udfs.geodesic_distance(metric, F.col(vec), q)), k, id_col=id_col)
    return found if max_distance is None else found.where(F.col("distance") <= max_distance)


def ball(points: DataFrame, query: Sequence[float], radius: float, metric: str, reach: float = 2.0, vec: str = "vector") -> DataFrame:
    """Points within the geodesic radius; those whose chord exceeds reach * radius are not solved for."""
    if radius < 0:
        raise ValueError("the radius must not be negative")
    q = V.literal(query)
    near = points.where(F.col(vec).isNotNull()).withColumn("chord", udfs.chord(metric, F.col(vec), q)).where(F.col("chord") <= reach * radius)
    return near.withColumn("distance", udfs.geodesic_distance(metric, F.col(vec), q)).where(F.col("distance") <= radius)


def paths(pairs: DataFrame, metric: str, steps: int = 20) -> DataFrame:
    """(path_id, step, point, arc_length): steps + 1 points of the geodesic of each (path_id, a, b) in one chart."""
    rows = pairs.withColumn("__flat", udfs.geodesic_path(metric, F.col("a"), F.col("b"), steps)).withColumn("__length", udfs.geodesic_distance(metric, F.col("a"), F.col("b")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    n = F.size("a")
    return rows.select("path_id", "step", F.slice("__flat", F.col("step") * n + 1, n).alias("point"), (F.col("__length") * F.col("step") / steps).alias("arc_length"))


def chart_plan(transitions: list[tuple], start: int, end: int, point: Sequence[float]) -> list[tuple[int, list[float]]]:
    """The charts of the shortest chain with the point's coordinates in each; raises if they are not connected."""
    chain = atlas.shortest_chain(transitions, start, end)
    if not chain:
        raise KeyError("the charts are not connected")
    out, at = [(start, [float(x) for x in point])], np.array(point, float)
    for a, b in zip(chain, chain[1:], strict=False):
        matrix, bias = atlas.compose(transitions, [a, b])
        at = matrix @ at + bias
        out.append((b, at.tolist()))
    return out


def cross_chart_path(transitions: list[tuple], a: tuple[int, Sequence[float]], b: tuple[int, Sequence[float]], steps: int = 20) -> list[list[float]]:
    """Waypoints from a to b (chart, coordinates): the end is carried into the start's chart along the shortest chain."""
    end = chart_plan(transitions, b[0], a[0], b[1])[-1][1] if a[0] != b[0] else list(b[1])
    return np.linspace(np.array(a[1], float), np.array(end, float), steps + 1).tolist()


def cross_modal(points: DataFrame, query: Sequence[float], chart: object, modality: object, k: int, dim: int, id_col: str = "vec_id", vec: str = "vector") -> DataFrame:
    """Top k of the modality in the query's chart by distance of the first dim coordinates, with the whole distance."""
    q = V.literal(query)
    rows = points.where((F.col("chart") == F.lit(chart)) & (F.col("modality") == F.lit(modality)) & F.col(vec).isNotNull())
    rows = rows.withColumn("distance", V.euclidean(F.slice(vec, 1, dim), F.slice(q, 1, dim))).withColumn("residual", V.euclidean(F.col(vec), q))
    return search.top_k(rows, k, id_col=id_col)


# The anchor index as a table of assigned points.


def index_insert(assigned: DataFrame, new: DataFrame, anchors: DataFrame, id_col: str = "vec_id", vec: str = "vector") -> DataFrame:
    """assigned with the new points routed to their anchors; an id that is there already, or twice among the new, is an error."""
    rows = search.assign_anchors(new, anchors, id_col, vec)
    twice = new.groupBy(id_col).count().where("count > 1").select(id_col).unionByName(assigned.join(new.select(id_col), id_col, "left_semi").select(id_col))
    if found := twice.head(1):
        raise ValueError(f"id {found[0][0]} is in the index already")
    return assigned.unionByName(rows)


def index_delete(assigned: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return assigned.join(ids.select(id_col).distinct(), id_col, "left_anti")


def index_update(assigned: DataFrame, new: DataFrame, anchors: DataFrame, id_col: str = "vec_id", vec: str = "vector") -> DataFrame:
    """Points with new vectors leave their cells and are routed again."""
    return index_insert(index_delete(assigned, new, id_col), new, anchors, id_col, vec)


def evolve(points: DataFrame, new: DataFrame, dim: int, modality: str = "modality", vec: str = "vector") -> DataFrame:
    """points with the new ones as the modality after the largest, their vectors cut or filled up with zeros to dim."""
    after = points.agg(F.coalesce(F.max(modality), F.lit(-1))).first()[0] + 1
    kind = points.schema[modality].dataType
    fitted = V.padded(F.col(vec), dim)
    return points.unionByName(new.withColumn(vec, fitted).withColumn(modality, F.lit(after).cast(kind)), allowMissingColumns=True)


def tangent_norm(v: Column, matrix: Column) -> Column:
    """sqrt(max(v' G v, 0)) for a matrix given as rows."""
    return F.sqrt(F.greatest(V.dot(v, V.matvec(matrix, v)), F.lit(0.0)))
