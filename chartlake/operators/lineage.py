"""Lineage cuts in the shared folder, and ranks without a sort in one task."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own, which only a local master can share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or Path(tempfile.mkdtemp(prefix="checkpoints-")).as_uri())
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)._jdf
    # without the size estimate that a checkpoint hands on: joins multiply it, so it gets twice the digits each round
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(done.toJavaRDD(), done.schema()), df.sparkSession)


def numbered(rows: DataFrame, group: str | None, order: list[Column], name: str = "r") -> DataFrame:
    """Adds the 0-based place of each row in its group and the group's size as `name` and `name`_of.

    Rows are sorted by ranges, so a hot group is spread over tasks; a row for each group and partition, of checked
    size, gives the offsets.
    """
    mark = F.monotonically_increasing_id()
    key = F.lit(0) if group is None else F.col(group)
    placed = rows.withColumn("__g", key).orderBy("__g", *order)
    placed = checkpointed(placed.withColumn("__part", F.shiftright(mark, 33)).withColumn("__row", mark.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("__g", "__part").agg(F.min("__row").alias("first"), F.count("*").alias("n"))
    offsets, totals = [], {}
    for r in sorted(search.small_side(sizes), key=lambda r: r["__part"]):
        before = totals.get(r["__g"], 0)
        offsets.append((r["__g"], r["__part"], before - r["first"]))
        totals[r["__g"]] = before + r["n"]
    kind = placed.schema["__g"].dataType.simpleString()
    side = rows.sparkSession.createDataFrame([(*o, totals[o[0]]) for o in offsets], f"__og {kind}, __op long, __shift long, __of long")
    joined = placed.join(F.broadcast(side), F.col("__g").eqNullSafe(F.col("__og")) & (F.col("__part") == F.col("__op")))
    return joined.withColumn(name, F.col("__row") + F.col("__shift")).withColumn(f"{name}_of", F.col("__of")).drop("__g", "__part", "__row", "__og", "__op", "__shift", "__of")
