"""Readers and writers: CSV with comments, NPY, binary matrices, JSON, and tables as Parquet."""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(vector): rows of `dim` numbers; blank lines, # or % comments and rows of another arity are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where((F.col("line") != "") & ~F.col("line").rlike("^[#%]"))
    parts = F.transform(F.split("line", r"\s*,\s*"), lambda x: x.try_cast("double"))
    # a header is text and goes like any row that does not parse
    return lines.select(parts.alias("vector")).where((F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull()))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(row, vector) of files of the form [rows u32][columns u32][rows x columns f64], little-endian."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                n, d = struct.unpack_from("<II", raw)
                data = np.frombuffer(raw, "<f8", n * d, 8).reshape(n, d)
                for at in range(0, n, 4096):
                    part = data[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part.tolist(), pa.list_(pa.float64()))], ["row", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, vector array<double>")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, vector) of NPY files, decoded on executors."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = np.atleast_2d(np.load(io.BytesIO(content.as_py()), allow_pickle=False)).astype(float)
                for at in range(0, len(data), 4096):
                    part = data[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part.tolist(), pa.list_(pa.float64()))], ["row", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, vector array<double>")


def from_numpy(spark: SparkSession, data, modality: str = "default", first_id: int = 0) -> DataFrame:
    """A points table from an (n, d) or (d,) array; empty or higher-dimensional input is an error."""
    data = np.atleast_2d(np.asarray(data, float))
    if data.ndim != 2 or data.size == 0:
        raise ValueError("expected a non-empty one- or two-dimensional array")
    return spark.createDataFrame([(first_id + i, row.tolist(), modality) for i, row in enumerate(data)], "vec_id long, vector array<double>, modality string")


def export(points: DataFrame, path: str, kind: str = "parquet") -> None:
    """JSON and Parquet keep nested columns; CSV gets arrays and maps as JSON text."""
    if kind == "csv":
        nested = [f.name for f in points.schema if f.dataType.typeName() in ("array", "map", "struct")]
        points = points.withColumns({c: F.to_json(c) for c in nested})
        points.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind in ("json", "parquet"):
        getattr(points.write.mode("overwrite"), kind)(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def load(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The inverse of export; the schema is given, so nothing is inferred."""
    fields = spark.createDataFrame([], schema).schema
    if kind == "csv":
        nested = {f.name: f.dataType for f in fields if f.dataType.typeName() in ("array", "map", "struct")}
        flat = ", ".join(f"{f.name} string" if f.name in nested else f"{f.name} {f.dataType.simpleString()}" for f in fields)
        rows = spark.read.schema(flat).option("header", True).option("escape", '"').csv(path)
        return rows.withColumns({c: F.from_json(c, t) for c, t in nested.items()})
    return getattr(spark.read.schema(fields), kind)(path)


TABLES = ("charts", "transitions", "metrics", "points")


def save_store(tables: dict[str, DataFrame], path: str, partition_points_by: str | None = None) -> None:
    """One Parquet folder per table; points may be partitioned, so that a chart's or anchor's rows can be pruned to."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if name == "points" and partition_points_by:
            writer = writer.partitionBy(partition_points_by)
        writer.parquet(f"{path}/{name}")


def load_store(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
