"""Communities and diffusion coordinates of the points of a k-NN graph; the graph stays a table of symmetric (i, j, w)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search
from .lineage import checkpointed

#: Vectors that are iterated together, and products between two Rayleigh-Ritz steps.
BLOCK, POWERS = 8, 4
#: Edges that a task multiplies at once. A block and its products are held by the driver if they fit search.MAX_SIDE_BYTES.
EDGES = 1 << 17


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 24) -> DataFrame:
    """(id, community) by rounds of local moves of modularity gain, then the same on the graph of communities.

    In a round every other node, by a hash, goes to the neighbouring community of largest gain (ties: lowest id), so two
    neighbours rarely swap places. A community is named by a node.
    """
    edges = checkpointed(edges.select("i", "j", "w"))
    twice = edges.agg(F.sum("w")).first()[0]
    member = checkpointed(edges.select(F.col("i").alias("id")).distinct().withColumn("community", F.col("id")))
    while twice:
        if not edges.where("i <> j").head(1):
            break
        degree = edges.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("k"))
        own = checkpointed(degree.withColumn("c", F.col("id")))
        ties, moved_any, still = edges.where("i <> j"), False, 0
        for n in range(rounds):
            mass = own.groupBy("c").agg(F.sum("k").alias("mass"))
            links = ties.join(own.select(F.col("id").alias("j"), "c"), "j").groupBy(F.col("i").alias("id"), "c").agg(F.sum("w").alias("w"))
            links = links.unionByName(own.select("id", "c", F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))
            rows = links.join(own.select("id", "k", F.col("c").alias("now")), "id").join(mass, "c")
            stays = F.col("c") == F.col("now")
            gain = F.col("w") - resolution * F.col("k") * (F.col("mass") - F.when(stays, F.col("k")).otherwise(0.0)) / twice
            rows = rows.withColumn("gain", gain)
            best = rows.groupBy("id", "k", "now").agg(F.max(F.when(stays, F.col("gain"))).alias("stay"), F.min(F.struct(-F.col("gain"), F.col("c"))).alias("b"))
            go = (-F.col("b.col1") > F.col("stay") + 1e-12) & (F.pmod(F.xxhash64("id", F.lit(n)), F.lit(2)) == 0)
            own = checkpointed(best.select("id", "k", F.when(go, F.col("b.c")).otherwise(F.col("now")).alias("c"), go.alias("moved")))
            moved = bool(own.where("moved").head(1))
            own, moved_any, still = own.drop("moved"), moved_any or moved, 0 if moved else still + 1
            if still == 2:
                break
        if not moved_any:
            break
        to = own.select(F.col("id").alias("community"), F.col("c").alias("next"))
        member = checkpointed(member.join(to, "community").select("id", F.col("next").alias("community")))
        for end in ("i", "j"):
            edges = edges.join(to.select(F.col("community").alias(end), "next"), end).drop(end).withColumnRenamed("next", end)
        edges = checkpointed(edges.groupBy("i", "j").agg(F.sum("w").alias("w")))
    return member


def merge_small(points: DataFrame, member: DataFrame, min_size: int, id_col: str = "vec_id", vec: str = "vector") -> DataFrame:
    """(id, community, merged): communities below min_size go to the large one with the nearest centroid."""
    at = F.posexplode(vec).alias("axis", "x")
    sums = points.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), vec).join(member, "id").select("community", at).groupBy("community", "axis").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    centres = checkpointed(sums.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "x"))), lambda s: s["x"]).alias("vector"), F.max("n").alias("n")))
    small = centres.where(F.col("n") < min_size).select(F.col("community").alias("query_id"), "vector")
    near = search.knn_batch(centres.where(F.col("n") >= min_size).select("community", "vector"), small, 1, id_col="community")
    to = near.select(F.col("query_id").alias("community"), F.col("community").alias("to"))
    return member.join(to, "community", "left").select("id", "community", F.coalesce("to", "community").alias("merged"))


def _normalised(edges: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Symmetric (i, j, s) of the normalised graph and its trivial eigenvector (id, root)."""

    def scaled(rows: DataFrame, by: DataFrame) -> DataFrame:
        for end in ("i", "j"):
            rows = rows.join(by.withColumnRenamed("id", end), end).withColumn("w", F.col("w") / F.col("f")).drop("f")
        return rows

    edges = checkpointed(scaled(edges, edges.groupBy(F.col("i").alias("id")).agg(F.pow(F.sum("w"), alpha).alias("f"))))
    root = checkpointed(edges.groupBy(F.col("i").alias("id")).agg(F.sqrt(F.sum("w")).alias("f")))
    return checkpointed(scaled(edges, root).withColumnRenamed("w", "s")), root.withColumnRenamed("f", "root")


def _products(rows: DataFrame) -> np.ndarray:
    """The products of all columns of array x with each other, summed in the tasks."""

    def run(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
                total = total + x.T @ x
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    parts = rows.select("x").mapInArrow(run, "g array<double>").collect()
    total = np.sum([r["g"] for r in parts], axis=0)
    return total.reshape(int(np.sqrt(total.size)), -1)


def _combined(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Column x times the matrix."""

    def run(batches):
        for batch in batches:
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) @ matrix if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, x array<double>")


def diffusion_coordinates(edges: DataFrame, dims: int = 2, alpha: float = 0.5, tolerance: float = 1e-6, rounds: int = 80) -> DataFrame:
    """(id, coordinates): the diffusion map of a symmetric graph (see learning.spectral_map) by block power iteration.

    A Rayleigh-Ritz step on the space of BLOCK vectors and their products with the graph gives the next block, until the
    residuals are within the tolerance. Up to search.MAX_SIDE_BYTES (838,860 points) the vectors are held by the driver
    and sent to the tasks, which keep the edges; beyond that they are tables, whose column products alone reach the driver.
    """
    graph, root = _normalised(edges.where("i <> j"), alpha)
    start = [F.col("root")] + [F.xxhash64("id", F.lit(k)) / float(2**63) for k in range(BLOCK - 1)]
    first = root.select("id", F.array(*start).alias("x"))
    held = root.count() * 8 * BLOCK * (POWERS + 1) <= search.MAX_SIDE_BYTES
    block, theta = (_iterated_held if held else _iterated)(graph, first, dims, tolerance, rounds)
    axes = [F.col("x")[c] * float(theta[c]) / F.col("root") for c in range(1, min(dims + 1, len(theta)))]
    out = checkpointed(block.join(root, "id").select("id", F.array(*axes).alias("coordinates")))
    first = out.agg(*[F.max_by(F.col("coordinates")[c], F.struct(F.round(F.abs(F.col("coordinates")[c]), 9), -F.col("id"))).alias(f"c{c}") for c in range(len(axes))]).first()
    signs = [1.0 if x is None or x >= 0 else -1.0 for x in first]
    return out.select("id", F.array(*[F.col("coordinates")[c] * s for c, s in enumerate(signs)]).alias("coordinates"))


def _ritz(gram: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(values, combinations of the first m columns, residuals) from the products of m columns and their images."""
    width = len(gram) - m
    g, a, aa = gram[:m, :m], gram[:m, width:], gram[width:, width:]  # columns; with their images; images
    scale = 1 / np.sqrt(np.diag(g).clip(1e-300))
    values, vectors = np.linalg.eigh(g * scale[:, None] * scale[None, :])
    keep = values > 1e-11 * values.max()
    white = scale[:, None] * vectors[:, keep] / np.sqrt(values[keep])
    small = white.T @ a @ white
    theta, y = np.linalg.eigh((small + small.T) / 2)
    width = min(BLOCK, len(theta))
    theta, y = theta[::-1][:width], (white @ y[:, ::-1][:, :width])
    gaps = [float(np.sqrt(max(0.0, y[:, c] @ aa @ y[:, c] - 2 * theta[c] * (y[:, c] @ a @ y[:, c]) + theta[c] ** 2))) for c in range(width)]
    return theta, y, gaps


def _packed(graph: DataFrame, ids) -> DataFrame:
    """The edges as (rows, starts, columns, values) in bytes, EDGES at once, rows and columns by their places in ids."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= EDGES:
                yield one(held)
                held, n = [], 0
        if n:
            yield one(held)

    def one(held):
        part = pa.Table.from_batches(held)
        i, j = (pc.index_in(part.column(c), value_set=ids.value).to_numpy().astype(np.int32) for c in ("i", "j"))
        order = np.lexsort((j, i))
        rows, starts = np.unique(i[order], return_index=True)
        cells = (rows, starts.astype(np.int64), j[order], part.column("s").to_numpy()[order])
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["rows", "starts", "columns", "cells"])

    return checkpointed(graph.select("i", "j", "s").mapInArrow(run, "rows binary, starts binary, columns binary, cells binary"))


def _iterated_held(graph: DataFrame, first: DataFrame, dims: int, tolerance: float, rounds: int) -> tuple[DataFrame, np.ndarray]:
    context = graph.sparkSession.sparkContext
    table = first.toArrow()
    table = table.take(pc.sort_indices(table.column("id")))
    names = table.column("id").combine_chunks()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, BLOCK)
    ids = context.broadcast(names)
    edges, theta = _packed(graph, ids), np.zeros(0)

    def product(v: np.ndarray) -> np.ndarray:
        sent = context.broadcast(v)

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    starts, columns, cells = np.frombuffer(r["starts"], np.int64), np.frombuffer(r["columns"], np.int32), np.frombuffer(r["cells"])
                    sums = np.add.reduceat(cells[:, None] * sent.value[columns], starts, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([r["rows"]], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["rows", "sums"])

        out = np.zeros_like(v)
        for part in edges.mapInArrow(run, "rows binary, sums binary").toArrow().to_batches():
            for rows, sums in zip(part.column(0), part.column(1), strict=True):
                out[np.frombuffer(rows.as_buffer(), np.int32)] += np.frombuffer(sums.as_buffer()).reshape(-1, v.shape[1])
        sent.destroy()
        return out

    for _ in range(rounds):
        blocks = [x]
        for _ in range(POWERS):
            blocks.append(product(blocks[-1]))
        every = np.concatenate(blocks, axis=1)
        m = x.shape[1] * POWERS
        theta, y, gaps = _ritz(every.T @ every, m)
        x = np.ascontiguousarray(every[:, :m] @ y)
        if max(gaps[: dims + 1]) <= tolerance:
            break
    last = context.broadcast(x)

    def rows(batches):
        for batch in batches:
            at = pc.index_in(batch.column(0), value_set=ids.value).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(last.value[at]), pa.list_(pa.float64()))], ["id", "x"])

    kind = first.schema["id"].dataType.simpleString()
    return first.select("id").mapInArrow(rows, f"id {kind}, x array<double>"), theta


def _iterated(graph: DataFrame, first: DataFrame, dims: int, tolerance: float, rounds: int) -> tuple[DataFrame, np.ndarray]:
    block, width, theta = checkpointed(first), BLOCK, np.zeros(0)
    for _ in range(rounds):
        all_x, last = block, block
        for p in range(POWERS):
            sums = [F.sum(F.col("s") * F.col("x")[c]) for c in range(width)]
            last = graph.join(last.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(F.array(*sums).alias("x"))
            all_x = all_x.join(last.withColumnRenamed("x", "y"), "id").select("id", F.concat("x", "y").alias("x"))
            if p % 2:
                all_x = checkpointed(all_x)
                last = all_x.select("id", F.slice("x", width * (p + 1) + 1, width).alias("x"))
        gram = _products(all_x)
        m = width * POWERS
        theta, y, gaps = _ritz(gram, m)
        width = len(theta)
        block = checkpointed(_combined(all_x, np.vstack([y, np.zeros((len(gram) - m, width))])))
        if max(gaps[: dims + 1]) <= tolerance:
            break
    return block, theta
