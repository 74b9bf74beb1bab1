"""The points table: insert, upsert, delete, update, lookup and statistics, as DataFrame to DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import search
from .lineage import numbered


def validated(points: DataFrame, dim: int | None = None, vec: str = "vector") -> DataFrame:
    """Points as they are; a null, empty or wrongly sized vector raises when rows are read."""
    ok = F.col(vec).isNotNull() & (F.size(vec) == dim if dim else F.size(vec) > 0)
    return points.withColumn(vec, F.when(ok, F.col(vec)).otherwise(F.raise_error(F.lit("bad vector dimension"))))


def with_new_ids(points: DataFrame, new: DataFrame, id_col: str = "point_id") -> DataFrame:
    """new with ids that continue the largest id of the table without gaps, in one sequence over all modalities.

    Each partition numbers its rows from the sum of the sizes before it; one count per partition reaches the driver.
    """
    top = points.agg(F.coalesce(F.max(id_col), F.lit(-1))).first()[0]
    mark = F.monotonically_increasing_id()
    rows = new.withColumn("__part", F.shiftright(mark, 33)).withColumn("__row", mark.bitwiseAND(F.lit((1 << 33) - 1)))
    offsets, total = [], top + 1
    for part, n in sorted(tuple(r) for r in rows.groupBy("__part").count().collect()):
        offsets += [F.lit(part).cast("long"), F.lit(total).cast("long")]
        total += n
    start = F.create_map(*offsets)[F.col("__part")] if offsets else F.lit(total)
    return rows.withColumn(id_col, F.col("__row") + start).drop("__part", "__row")


def with_modality_ids(points: DataFrame, new: DataFrame, order: list[Column], modality: str = "modality", id_col: str = "point_id") -> DataFrame:
    """new with ids that continue the largest id of their own modality, in the given total order; a new one starts at 0.

    Rows without modality are a modality too. No modality is numbered in one task; the largest ids are a checked side.
    """
    placed = numbered(new.drop(id_col), modality, order, "__at")
    last = search.checked(points.groupBy(F.col(modality).alias("__of")).agg(F.max(id_col).alias("__last")))
    joined = placed.join(last, F.col(modality).eqNullSafe(F.col("__of")), "left")
    return joined.withColumn(id_col, F.coalesce(F.col("__last"), F.lit(-1)) + 1 + F.col("__at")).drop("__at", "__at_of", "__of", "__last")


def latest(points: DataFrame, order: list[Column], id_col: str = "vec_id") -> DataFrame:
    """One row per id, the first in the given order (last write wins if it is descending by time)."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return points.withColumn("__r", rank).where(F.col("__r") == 1).drop("__r")


def upsert(points: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return points.join(new.select(id_col).distinct(), id_col, "left_anti").unionByName(new)


def delete(points: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return points.join(ids.select(id_col).distinct(), id_col, "left_anti")


def update(points: DataFrame, changes: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Columns of changes replace those of points where they are not null."""
    fields = [c for c in changes.columns if c != id_col]
    renamed = changes.select(id_col, *[F.col(c).alias(f"__new_{c}") for c in fields])
    joined = points.join(renamed, id_col, "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in fields else F.col(c) for c in points.columns])


def get_batch(points: DataFrame, ids: list, id_col: str = "vec_id") -> DataFrame:
    """Rows of the ids in the given order; missing ones are skipped."""
    spark = points.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "ordinal int, wanted long")
    return F.broadcast(wanted).join(points, F.col("wanted") == F.col(id_col)).drop("wanted").orderBy("ordinal")


def stats(points: DataFrame, *groups: str) -> DataFrame:
    """Counts for every grouping set of the columns, with the number of grouped columns as level."""
    return points.cube(*groups).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
