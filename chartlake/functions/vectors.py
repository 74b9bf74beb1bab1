"""Vector kernels as Column expressions; everything stays in the JVM.

Vectors are ARRAY<DOUBLE>. A null operand gives null. Vectors of unequal length give null in zip_with arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(col: Column) -> Column:
    return col.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + (y - x) * t)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; a zero vector has distance 1."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size))


def diagonal(weights: Sequence[float]):
    """sqrt of the weighted square sum."""
    w = literal(weights)

    def distance(a: Column, b: Column) -> Column:
        squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.abs(dot(squares, w)))

    return distance


def mahalanobis(a: Column, b: Column, matrix: Column) -> Column:
    """sqrt(abs(d' G d)) for a matrix given as rows."""
    d = minus(a, b)
    return F.sqrt(F.abs(dot(d, matvec(matrix, d))))


def conformal(a: Column, b: Column) -> Column:
    """Length under g(m) = (1 + |m|^2) I taken at the midpoint m."""
    middle = F.zip_with(a, b, lambda x, y: (x + y) / 2.0)
    return F.sqrt((1.0 + dot(middle, middle)) * total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def fisher_rao(a: Column, b: Column) -> Column:
    """2 acos(sum sqrt(p q)) of the vectors normalised to sum 1."""
    mass = F.zip_with(a, b, lambda x, y: F.sqrt(x * y))
    return 2.0 * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), total(mass) / F.sqrt(total(a) * total(b)))))


def matvec(matrix: Column, v: Column) -> Column:
    return F.transform(matrix, lambda row: dot(row, v))


def matrix_literal(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[literal(r) for r in rows])


def affine(matrix: Column, bias: Column, v: Column) -> Column:
    return plus(matvec(matrix, v), bias)


def padded(v: Column, dim: int) -> Column:
    """Cut to dim entries or filled up with zeros."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dim)), 1, dim)


METRICS = {"euclidean": euclidean, "cosine": cosine, "manhattan": manhattan, "conformal": conformal, "fisher_rao": fisher_rao, "fischer_rao": fisher_rao, "geodesic": euclidean}


def distance(metric: str):
    """The distance of that name. 'geodesic' is the flat one: under a constant metric it has the closed form."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(METRICS)}")
    return METRICS[metric]
