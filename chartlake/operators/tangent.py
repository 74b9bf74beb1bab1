"""Tangent spaces at anchors, boxes of groups, samples of geodesic balls, and the registry of charts and transitions.

A space is a tuple (anchor_id, base, basis, metric): basis rows are orthonormal, the metric is in tangent coordinates.
Anchors and charts are a side of bounded size that the driver holds; points stay in DataFrames.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import udfs
from ..functions import vectors as V
from . import atlas, search

SPACES = "anchor_id long, base array<double>, basis array<array<double>>, metric array<array<double>>"
#: Spaces fitted in one pass: each brings ambient x ambient sums to the driver (64 dimensions: 33 KB).
MAX_SPACES = 4096


def tangent_spaces(assigned: DataFrame, anchors: dict, ambient: int, dim: int | None = None, share: float = 0.95, vec: str = "vector") -> list[tuple]:
    """A space per anchor from the points assigned to it (anchor_id, vec); anchors maps ids to base points.

    Tasks sum moments, so no group is ever gathered. Without dim, the least number of axes with the share of the
    squared length is taken. The metric is I + 1e-3 * covariance / its largest entry. Anchors without points are left out.
    """
    if len(anchors) > MAX_SPACES:
        raise ValueError(f"more than {MAX_SPACES} anchors")
    out = []
    for key, (n, mean, _, sums) in sorted(atlas.grouped_moments(assigned, F.col("anchor_id"), ambient, vec).items()):
        base = np.array(anchors[key], float)
        about = n * (sums / n - np.outer(mean, base) - np.outer(base, mean) + np.outer(base, base))
        values, axes = np.linalg.eigh((about + about.T) / 2)
        values, axes = values[::-1].clip(0), axes.T[::-1]
        d = dim or (int(np.searchsorted(np.cumsum(values), share * values.sum() - 1e-12)) + 1 if values.sum() > 0 else 1)
        basis = G.fixed_signs(axes[: min(d, ambient)])
        cov = basis @ about @ basis.T / max(n - 1, 1)
        metric = np.eye(len(basis)) + (1e-3 * cov / (np.abs(cov).max() + 1e-12) if n > len(basis) else 0)
        out.append((int(key), base.tolist(), basis.tolist(), metric.tolist()))
    return out


def log_at(v: Column, base: Column, basis: Column, ambient: int) -> Column:
    """Tangent coordinates of v, shortened by max(0.5, 1 - s^2 / (24 (ambient + 1))) for a point at distance s."""
    gap = V.minus(v, base)
    return V.scaled(V.matvec(basis, gap), F.greatest(F.lit(0.5), 1 - V.dot(gap, gap) / (24.0 * (ambient + 1))))


def exp_at(local: Column, base: Column, basis: Column) -> Column:
    """The point with these tangent coordinates. A space has one metric, so the second-order term vanishes."""
    return atlas.embed(local, base, basis)


def _aligned(basis: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The same span in the frame that is closest to the other basis."""
    return G.tangent_rotation(basis, to) @ basis


def updated_basis(space: tuple, n: int, mean: np.ndarray, sums: np.ndarray, rate: float = 0.1) -> tuple:
    """The space turned towards a batch, given by its moments, at the rate; orthonormal again."""
    base, basis = np.array(space[1], float), np.array(space[2], float)
    if not n:
        return space
    about = sums / n - np.outer(mean, base) - np.outer(base, mean) + np.outer(base, base)
    fresh = np.linalg.eigh((about + about.T) / 2)[1].T[::-1][: len(basis)]
    blend = G.gram_schmidt((1 - rate) * basis + rate * _aligned(fresh, basis))
    return (space[0], space[1], blend.tolist(), space[3])


def blended_space(spaces: list[tuple], point: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(base, basis) at a point: the k nearest spaces of the nearest one's dimension, weighted by inverse squared distance."""
    if not spaces:
        raise ValueError("no tangent spaces")
    near = sorted(spaces, key=lambda s: (float(np.linalg.norm(np.array(s[1]) - point)), s[0]))
    first = np.array(near[0][2], float)
    near = [s for s in near if len(s[2]) == len(first)][:k]
    weights = np.array([1 / max(float(((np.array(s[1]) - point) ** 2).sum()), 1e-12) for s in near])
    weights /= weights.sum()
    blend = sum(w * _aligned(np.array(s[2], float), first) for w, s in zip(weights, near, strict=True))
    return sum(w * np.array(s[1], float) for w, s in zip(weights, near, strict=True)), G.gram_schmidt(blend)


def carried(source: tuple, target: tuple, v: np.ndarray) -> np.ndarray:
    """v in the target's tangent coordinates by the closest rotation, with the length it had in the source."""
    moved = G.tangent_rotation(np.array(source[2]), np.array(target[2])) @ v
    was, now = (float(np.sqrt(max(0.0, x @ np.array(s[3]) @ x))) for x, s in ((v, source), (moved, target)))
    return moved * (was / now) if now > 1e-12 else moved


def box_distance(q: Column, lo: Column, hi: Column) -> Column:
    """The least distance from a point to a box, 0 inside."""
    below, above = V.minus(lo, q), V.minus(q, hi)
    return V.norm(F.zip_with(below, above, lambda a, b: F.greatest(a, b, F.lit(0.0))))


def boxes_meet(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    low = F.forall(F.zip_with(lo, other_hi, lambda a, b: a <= b), lambda ok: ok)
    return low & F.forall(F.zip_with(other_lo, hi, lambda a, b: a <= b), lambda ok: ok)


def pruned_ball(points: DataFrame, boxes: DataFrame, query: list[float], radius: float, group: str, vec: str = "vector") -> DataFrame:
    """The ball around the query, reading only groups whose box (group, lo, hi) comes close enough.

    Exact, as a box bounds its members from below. With points partitioned by the group, the others are not read.
    """
    q = V.literal(query)
    near = [r[group] for r in search.small_side(boxes.where(box_distance(q, F.col("lo"), F.col("hi")) <= radius).select(group))]
    return search.ball(points.where(_of_groups(group, near)), query, radius, vec=vec)


def _of_groups(group: str, names: list) -> Column:
    """Members of the named groups; those without a group are one too."""
    found = F.col(group).isin([x for x in names if x is not None])
    return found | F.col(group).isNull() if None in names else found


def pruned_knn(points: DataFrame, boxes: DataFrame, query: list[float], k: int, group: str, id_col: str = "vec_id", vec: str = "vector") -> DataFrame:
    """Top k, reading only groups whose box (group, lo, hi, n members) can hold one of them.

    The nearest boxes by their farthest corner that have k members together bound the kth distance; a box that begins
    beyond it has none of the k. Exact for any number of members, also if there are fewer than k in all.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    q = V.literal(query)
    corner = F.zip_with(V.minus(F.col("lo"), q), V.minus(F.col("hi"), q), lambda a, b: F.greatest(F.abs(a), F.abs(b)))
    held = search.small_side(boxes.where("n > 0").select(group, "n", box_distance(q, F.col("lo"), F.col("hi")).alias("near"), V.norm(corner).alias("far")))
    reach, members = float("inf"), 0
    for r in sorted(held, key=lambda r: r["far"]):
        members += r["n"]
        if members >= k:
            reach = r["far"] * (1 + 1e-9)  # more than the rounding of both bounds
            break
    near = [r[group] for r in held if r["near"] <= reach]
    rows = points.where(_of_groups(group, near) & F.col(vec).isNotNull())
    return search.top_k(rows.withColumn("distance", V.euclidean(F.col(vec), q)), k, id_col=id_col)


def ball_samples(centres: DataFrame, metric: str, radius: float, n: int, dim: int, id_col: str = "vec_id", at: str = "point", seed: int = 42) -> DataFrame:
    """(id, sample, point): n samples of the geodesic ball around every centre, at radius * u^(1/dim) along a random direction.

    Directions are normal in coordinates that are orthonormal at the centre. Random numbers are hashes of id, sample
    number and seed, so reruns and retried tasks agree.
    """
    rows = centres.where(F.col(at).isNotNull()).select(id_col, at, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))

    def uniform(i: int) -> Column:
        return (F.pmod(F.xxhash64(F.col(id_col), "sample", F.lit(seed), F.lit(i)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    normals = F.array(*[F.sqrt(-2 * F.log(uniform(2 * i))) * F.cos(2 * np.pi * uniform(2 * i + 1)) for i in range(dim)])
    reach = radius * F.pow(uniform(2 * dim), F.lit(1.0 / dim))
    unit = V.scaled(normals, reach / V.norm(normals))
    return rows.select(id_col, "sample", udfs.exp_orthonormal(metric, F.col(at), unit).alias("point"))


class Registry:
    """Charts and transitions by id, held by the driver; tables() gives them as DataFrames for plans and stores."""

    def __init__(self, charts: list[tuple] = (), transitions: list[tuple] = ()):
        self.charts, self.transitions = {}, {}
        for c in charts:
            self.add_chart(c)
        for t in transitions:
            self.add_transition(t)

    def add_chart(self, chart: tuple) -> None:
        if chart[0] in self.charts:
            raise ValueError(f"chart {chart[0]} exists")
        if len(self.charts) >= search.MAX_SIDE:
            raise ValueError(f"more than {search.MAX_SIDE} charts")
        self.charts[chart[0]] = tuple(chart)

    def chart(self, chart_id: int) -> tuple:
        return self.charts[chart_id]

    def remove_chart(self, chart_id: int) -> None:
        """With its transitions."""
        del self.charts[chart_id]
        self.transitions = {k: t for k, t in self.transitions.items() if chart_id not in k}

    def add_transition(self, transition: tuple) -> None:
        src, tgt, matrix, bias = transition
        missing = [c for c in (src, tgt) if c not in self.charts]
        if missing:
            raise KeyError(f"no chart {missing[0]}")
        if len(matrix) != len(bias):
            raise ValueError("matrix and bias differ in size")
        self.transitions[src, tgt] = (src, tgt, matrix, bias)

    def transition(self, src: int, tgt: int) -> tuple:
        return self.transitions[src, tgt]

    def chain(self, src: int, tgt: int) -> tuple[np.ndarray, np.ndarray]:
        """One map along the shortest chain of charts; KeyError if they are not connected."""
        maps = list(self.transitions.values())
        return atlas.compose(maps, atlas.shortest_chain([(s, t) for s, t, *_ in maps], src, tgt))

    def isolated(self) -> list[int]:
        tied = {c for k in self.transitions for c in k}
        return sorted(c for c in self.charts if c not in tied)

    def summary(self) -> dict:
        dims = [len(c[2]) for c in self.charts.values()]
        return {"charts": len(self.charts), "transitions": len(self.transitions), "isolated": self.isolated(), "dims": sorted(set(dims)), "ambient": sorted({len(c[1]) for c in self.charts.values()})}

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"charts": spark.createDataFrame(list(self.charts.values()), atlas.CHARTS), "transitions": spark.createDataFrame(list(self.transitions.values()), atlas.TRANSITIONS)}

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame]) -> Registry:
        return cls([tuple(r) for r in search.small_side(tables["charts"])], [tuple(r) for r in search.small_side(tables["transitions"])])


def quality(located: DataFrame, overlaps: DataFrame, registry: Registry, threshold: float) -> dict:
    """Share of points within the threshold of their chart, share that lies in overlaps, and the registry's summary."""
    row = located.agg(F.count("*").alias("n"), F.avg((F.col("residual") <= threshold).cast("int")).alias("coverage")).first()
    shared = overlaps.select("vec_id").distinct().count()
    return {"points": row["n"], "coverage": row["coverage"] or 0.0, "overlap": shared / row["n"] if row["n"] else 0.0, **registry.summary()}
