"""Paths as rows (path_id, step, point): flat geodesics, energy, curvature, length and resampling.

All windows are partitioned by path, so a path's rows meet in one task and paths spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from .lineage import numbered

def _along():
    return Window.partitionBy("path_id").orderBy("step")


def straight_paths(pairs: DataFrame, steps: int = 20) -> DataFrame:
    """(path_id, step, point, arc_length) with steps + 1 points of the flat geodesic of each (path_id, a, b)."""
    rows = pairs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    t = F.col("step") / F.lit(float(steps))
    return rows.select("path_id", "step", V.lerp(F.col("a"), F.col("b"), t).alias("point"), (V.euclidean(F.col("a"), F.col("b")) * t).alias("arc_length"))


def segments(paths: DataFrame) -> DataFrame:
    """Adds the previous point, the segment length and the length so far."""
    rows = paths.withColumn("before", F.lag("point").over(_along()))
    rows = rows.withColumn("segment", F.coalesce(V.euclidean(F.col("point"), F.col("before")), F.lit(0.0)))
    return rows.withColumn("upto", F.sum("segment").over(_along().rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def energy(paths: DataFrame) -> DataFrame:
    """(path_id, length, energy): energy is half the sum of squared speed times the time step, over unit time."""
    rows = segments(paths).groupBy("path_id").agg(F.sum("segment").alias("length"), F.sum(F.col("segment") * F.col("segment")).alias("sq"), (F.count("*") - 1).alias("n"))
    return rows.select("path_id", "length", (0.5 * F.col("sq") * F.col("n")).alias("energy"))


def curvature(paths: DataFrame) -> DataFrame:
    """(path_id, step, curvature) at inner points: turning of unit tangents over the mean segment length."""
    rows = paths.withColumn("p", F.lag("point").over(_along())).withColumn("n", F.lead("point").over(_along())).where("p is not null and n is not null")
    a, b = V.minus(F.col("point"), F.col("p")), V.minus(F.col("n"), F.col("point"))
    la, lb = V.norm(a), V.norm(b)
    turn = V.norm(F.zip_with(a, b, lambda x, y: y / F.nullif(lb, F.lit(0.0)) - x / F.nullif(la, F.lit(0.0))))
    return rows.select("path_id", "step", F.coalesce(turn / ((la + lb) / 2), F.lit(0.0)).alias("curvature"))


def resample(paths: DataFrame, steps: int) -> DataFrame:
    """Points at equal arc lengths: each target length is joined to the segment that contains it."""
    rows = segments(paths)
    total = rows.groupBy("path_id").agg(F.max("upto").alias("total"))
    spans = rows.where("before is not null").join(total, "path_id")
    start, share = F.col("upto") - F.col("segment"), F.col("total") / F.lit(float(steps))
    # the targets of a segment: multiples of the step in (start, end], and 0 for the first one
    spans = spans.where("segment > 0").withColumn("first", F.when(start <= 0, F.lit(0)).otherwise(F.floor(start / share + 1e-9) + 1)).withColumn("last", F.floor(F.col("upto") / share + 1e-9))
    spans = spans.where("first <= last").withColumn("k", F.explode(F.sequence("first", "last")))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("k") * share - start) / F.col("segment")))
    return spans.select("path_id", F.col("k").cast("int").alias("step"), V.lerp(F.col("before"), F.col("point"), t).alias("point"))


def retract(point: Column, velocity: Column) -> Column:
    return V.plus(point, velocity)


def inverse_retract(point: Column, other: Column, weights: Column) -> Column:
    """g^-1 times the difference, for a diagonal metric."""
    return F.zip_with(V.minus(other, point), weights, lambda d, w: d / w)


def triangle_violations(distances: DataFrame) -> DataFrame:
    """Triples of (i, j, d) rows with d(i, k) > d(i, j) + d(j, k)."""
    a = distances.toDF("i", "j", "dij")
    b = distances.toDF("j", "k", "djk")
    c = distances.toDF("i", "k", "dik")
    return a.join(b, "j").join(c, ["i", "k"]).where("dik > dij + djk + 1e-9")


# Transport of vectors between schemas and through time, flat metrics.


def schema_transport(v: Column, source_dim: int, target_dim: int, shift: Column | None = None) -> Column:
    """Equal dimensions: v plus the shift of the reference points; else cut or filled up with zeros."""
    if source_dim != target_dim:
        return V.padded(v, target_dim)
    return v if shift is None else V.plus(v, shift)


def with_length_of(moved: Column, v: Column) -> Column:
    """moved, scaled to the length of v (null: null); as it is where it has no length itself."""
    size = V.norm(moved)
    return F.when(size > 1e-12, F.when(v.isNotNull(), V.scaled(moved, V.norm(v) / size))).otherwise(moved)


def centroid_drift(rows: DataFrame, step: str, vec: str, dim: int) -> DataFrame:
    """(step, centroid, drift): mean vector of each time step and its distance from the previous step's."""
    means = rows.groupBy(step).agg(*[F.avg(F.get(F.col(vec), F.lit(i))).alias(f"c{i}") for i in range(dim)])
    means = means.select(step, F.array(*[f"c{i}" for i in range(dim)]).alias("centroid"))
    placed = numbered(means, None, [F.col(step)]).drop("r_of")
    before = placed.select((F.col("r") + 1).alias("r"), F.col("centroid").alias("__before"))
    means = placed.join(before, "r", "left").drop("r")
    return means.withColumn("drift", F.coalesce(V.euclidean(F.col("centroid"), F.col("__before")), F.lit(0.0))).drop("__before")
