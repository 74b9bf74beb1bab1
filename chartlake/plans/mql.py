"""The query language: text or a fluent builder -> Query -> DataFrame plan.

    SELECT f, ... FROM points [ALONG manifold 'a'] [USING metric 'm']
        [WHERE geodesic_distance(col, [x, ...]) < eps] [ORDER BY f [DESC]] [LIMIT n]
    TANGENT_QUERY FROM chart 'c' [NEAR [x, ...]] WHERE distance < eps [TOP_K k]
    CROSS_MODAL FROM 's' TO 't' TRANSPORT VIA 'x' [NEAR [x, ...]] [TOP_K k]
    PARALLEL_TRANSPORT [x, ...] FROM a TO b

Clauses may come in any order. A constant metric is planned as a closed Column expression (no Python); limits become
TakeOrderedAndProject; ids are projected before wide columns are read.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions import vectors as V
from ..operators import curved, search


class QueryType(Enum):
    SELECT = "select"
    TANGENT = "tangent"
    CROSS_MODAL = "cross_modal"
    TRANSPORT = "transport"
    RANGE = "range"


class CostTier(Enum):
    CHEAP = 1
    MODERATE = 2
    EXPENSIVE = 3
    VERY_EXPENSIVE = 4


class QueryError(ValueError):
    """The text or the query makes no sense."""


@dataclass(frozen=True)
class Query:
    type: QueryType = QueryType.SELECT
    source: str = "points"
    fields: tuple[str, ...] = ("*",)
    chart: str | None = None
    atlas: str | None = None
    metric: str = "euclidean"
    column: str = "vector"
    point: tuple[float, ...] | None = None
    operator: str = "<"
    epsilon: float | None = None
    k: int = 10
    modality: str | None = None
    target_modality: str | None = None
    via: str = "overlap_region"
    source_chart: str | None = None
    target_chart: str | None = None
    vector: tuple[float, ...] | None = None
    order_by: str | None = None
    descending: bool = False
    limit: int | None = None
    where: dict = field(default_factory=dict)

    def validate(self) -> list[str]:
        wrong = []
        if self.point is not None and not self.point:
            wrong.append("the query point is empty")
        if self.epsilon is not None and not self.epsilon > 0:
            wrong.append("epsilon must be positive")
        if self.k < 1 or self.limit is not None and self.limit < 1:
            wrong.append("k and LIMIT must be at least 1")
        if self.operator not in ("<", "<=", ">", ">="):
            wrong.append(f"unknown comparison {self.operator!r}")
        if self.type is QueryType.SELECT and self.epsilon is not None and self.point is None:
            wrong.append("a distance predicate needs a point")
        if self.type is QueryType.RANGE and (self.point is None or self.epsilon is None):
            wrong.append("a range query needs a point and epsilon")
        if self.type is QueryType.CROSS_MODAL and not (self.modality and self.target_modality):
            wrong.append("a cross-modal query needs both modalities")
        if self.type is QueryType.TRANSPORT and not (self.vector and self.source_chart and self.target_chart):
            wrong.append("a transport query needs a vector and both charts")
        return wrong

    def cost(self, chart_sizes: dict[str, int] | None = None) -> CostTier:
        fixed = {QueryType.TANGENT: CostTier.CHEAP, QueryType.TRANSPORT: CostTier.MODERATE, QueryType.CROSS_MODAL: CostTier.EXPENSIVE}
        size = (chart_sizes or {}).get(self.chart, 10_000)
        return fixed.get(self.type) or (CostTier.MODERATE if size < 1_000 else CostTier.EXPENSIVE if size < 100_000 else CostTier.VERY_EXPENSIVE)

    def to_dict(self) -> dict:
        return {k: v.value if isinstance(v, Enum) else list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, values: dict) -> Query:
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
        return cls(**own | {"type": QueryType(values.get("type", "select"))})


_TOKEN = re.compile(r"""\s*(?:(?P<text>'[^']*'|"[^"]*")|(?P<list>\[[^\]]*\])|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|(?P<name>[A-Za-z_][\w.]*)|(?P<op><=|>=|[<>=!]+|\*)|(?P<other>[(),;])|(?P<bad>\S))""")


def tokens(text: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    for m in _TOKEN.finditer(text):
        kind, raw = m.lastgroup, m[m.lastgroup]
        if kind == "bad":
            raise QueryError(f"unexpected {raw!r}")
        if kind == "text":
            out.append(("text", raw[1:-1]))
        elif kind == "list":
            try:
                out.append(("list", tuple(float(x) for x in re.split(r"[,\s]+", raw[1:-1].strip()) if x)))
            except ValueError as e:
                raise QueryError(f"not a vector: {raw}") from e
        elif kind == "number":
            out.append(("number", float(raw)))
        elif raw not in ";":
            out.append((kind, raw))
    return out


class _Reader:
    def __init__(self, text: str):
        self.left = tokens(text)

    def word(self) -> str:
        return self.left[0][1].upper() if self.left and self.left[0][0] == "name" else ""

    def take(self, *kinds: str):
        if not self.left or kinds and self.left[0][0] not in kinds:
            raise QueryError(f"expected {' or '.join(kinds) or 'more'}, got {self.left[0][1] if self.left else 'the end'!r}")
        return self.left.pop(0)[1]

    def skip(self, *words: str) -> bool:
        found = self.word() in words or bool(self.left) and self.left[0][1] in words
        if found:
            self.left.pop(0)
        return found

    def need(self, word: str) -> None:
        if not self.skip(word):
            raise QueryError(f"expected {word}")

    def count(self) -> int:
        value = self.take("number")
        if value != int(value):
            raise QueryError(f"expected a whole number, got {value}")
        return int(value)


def parse(text: str) -> Query:
    r, q = _Reader(text), Query()
    head = r.word()
    if not r.skip("SELECT", "TANGENT_QUERY", "CROSS_MODAL", "PARALLEL_TRANSPORT"):
        raise QueryError("a query starts with SELECT, TANGENT_QUERY, CROSS_MODAL or PARALLEL_TRANSPORT")
    if head == "SELECT":
        fields = [str(r.take("name", "op"))]
        while r.skip(","):
            fields.append(str(r.take("name", "op")))
        q = replace(q, fields=tuple(fields))
    elif head == "PARALLEL_TRANSPORT":
        q = replace(q, type=QueryType.TRANSPORT, vector=r.take("list"))
    elif head == "TANGENT_QUERY":
        q = replace(q, type=QueryType.TANGENT)
    else:
        q = replace(q, type=QueryType.CROSS_MODAL, modality="text", target_modality="image")
    while r.left:
        if r.skip("FROM"):
            r.skip("CHART")
            name = str(r.take("name", "text"))
            if head == "SELECT":
                q = replace(q, source=name)
            elif head == "TANGENT_QUERY":
                q = replace(q, chart=name)
            else:
                r.need("TO")
                other = str(r.take("name", "text"))
                q = replace(q, modality=name, target_modality=other) if head == "CROSS_MODAL" else replace(q, source_chart=name, target_chart=other)
        elif r.skip("ALONG"):
            r.skip("MANIFOLD")
            q = replace(q, atlas=str(r.take("name", "text")))
        elif r.skip("USING"):
            r.skip("METRIC")
            q = replace(q, metric=str(r.take("name", "text")).lower())
        elif r.skip("WHERE"):
            name = str(r.take("name"))
            if r.skip("("):
                q = replace(q, column=str(r.take("name")))
                r.need(",")
                q = replace(q, point=r.take("list"))
                r.need(")")
                if name.lower() != "geodesic_distance":
                    q = replace(q, metric=name.lower().removesuffix("_distance"))
            q = replace(q, operator=str(r.take("op")), epsilon=float(r.take("number")))
        elif r.skip("NEAR"):
            q = replace(q, point=r.take("list"))
        elif r.skip("TRANSPORT"):
            r.need("VIA")
            q = replace(q, via=str(r.take("name", "text")))
        elif r.skip("ORDER"):
            r.need("BY")
            q = replace(q, order_by=str(r.take("name")))
            if r.skip("DESC"):
                q = replace(q, descending=True)
            else:
                r.skip("ASC")
        elif r.skip("TOP_K"):
            q = replace(q, k=r.count())
        elif r.skip("LIMIT"):
            n = r.count()
            q = replace(q, limit=n) if head == "SELECT" else replace(q, k=n)
        else:
            raise QueryError(f"unexpected {r.left[0][1]!r}")
    if wrong := q.validate():
        raise QueryError("; ".join(wrong))
    return q


class Builder:
    """Fluent construction: Builder().select("vec_id").where_geodesic([..], 0.5).top_k(5).build()."""

    def __init__(self, query: Query | None = None):
        self._q = query or Query()

    def _with(self, **changes) -> Builder:
        return Builder(replace(self._q, **changes))

    def select(self, *fields: str) -> Builder:
        return self._with(fields=fields or ("*",))

    def from_source(self, name: str) -> Builder:
        return self._with(source=name)

    def from_chart(self, chart: str) -> Builder:
        return self._with(chart=chart)

    def along_manifold(self, atlas: str) -> Builder:
        return self._with(atlas=atlas)

    def using_metric(self, metric: str) -> Builder:
        return self._with(metric=metric)

    def where_geodesic(self, point, epsilon: float, operator: str = "<", column: str = "vector") -> Builder:
        return self._with(point=tuple(point), epsilon=epsilon, operator=operator, column=column)

    def range(self, point, epsilon: float) -> Builder:
        return self._with(type=QueryType.RANGE, point=tuple(point), epsilon=epsilon, operator="<=")

    def tangent_query(self, point, epsilon: float | None = None) -> Builder:
        return self._with(type=QueryType.TANGENT, point=tuple(point), epsilon=epsilon)

    def cross_modal(self, source: str, target: str, point=None) -> Builder:
        return self._with(type=QueryType.CROSS_MODAL, modality=source, target_modality=target, point=tuple(point) if point is not None else None)

    def with_transport(self, via: str) -> Builder:
        return self._with(via=via)

    def parallel_transport(self, vector, source: str, target: str) -> Builder:
        return self._with(type=QueryType.TRANSPORT, vector=tuple(vector), source_chart=source, target_chart=target)

    def top_k(self, k: int) -> Builder:
        if k < 1:
            raise QueryError("k must be at least 1")
        return self._with(k=k)

    def limit(self, n: int) -> Builder:
        if n < 1:
            raise QueryError("LIMIT must be at least 1")
        return self._with(limit=n)

    def order_by(self, name: str, descending: bool = False) -> Builder:
        return self._with(order_by=name, descending=descending)

    def with_metadata(self, **values) -> Builder:
        return self._with(where=self._q.where | values)

    def build(self) -> Query:
        if wrong := self._q.validate():
            raise QueryError("; ".join(wrong))
        return self._q


class Engine:
    """Plans queries over named tables. points need vec_id and vector, and chart or modality where a query names one.

    transitions: (source, target) names -> (matrix, bias); a missing pair of equal names is the identity.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], transitions: dict | None = None, tangent_dim: int = 8, id_col: str = "vec_id"):
        self.spark, self.tables, self.transitions, self.dim, self.id = spark, tables, transitions or {}, tangent_dim, id_col

    def sql(self, text: str) -> DataFrame:
        return self.execute(parse(text))

    def execute(self, q: Query) -> DataFrame:
        if wrong := q.validate():
            raise QueryError("; ".join(wrong))
        return getattr(self, f"_{q.type.value}")(q)

    def batch(self, queries: DataFrame, k: int = 10, metric: str = "euclidean", source: str = "points") -> DataFrame:
        """All rows of (query_id, vector) in one job."""
        return search.knn_batch(self.tables[source], queries, k, metric, self.id)

    def _points(self, q: Query) -> DataFrame:
        if q.source not in self.tables:
            raise QueryError(f"unknown source {q.source!r}")
        rows = self.tables[q.source]
        if q.chart is not None and "chart" in rows.columns:
            rows = rows.where(F.col("chart") == q.chart)
        for name, value in q.where.items():
            rows = rows.where(F.col(name) == F.lit(value))
        return rows

    @staticmethod
    def _holds(q: Query, distance):
        e = F.lit(float(q.epsilon))
        return {"<": distance < e, "<=": distance <= e, ">": distance > e, ">=": distance >= e}[q.operator]

    def _select(self, q: Query) -> DataFrame:
        rows = self._points(q)
        if q.point is not None and q.metric.startswith("geodesic:") and q.limit and not q.order_by and q.operator in ("<", "<="):
            # two stages: the exact distance is only solved for the nearest by the chord
            rows = curved.knn(rows, q.point, q.limit, q.metric.partition(":")[2], id_col=self.id, vec=q.column)
            rows = rows if q.epsilon is None else rows.where(self._holds(q, F.col("distance")))
        elif q.point is not None:
            rows = search.with_distance(rows, V.literal(q.point), q.metric, q.column)
            if q.epsilon is not None:
                rows = rows.where(self._holds(q, F.col("distance")))
        if q.order_by:
            rows = rows.orderBy(F.desc(q.order_by) if q.descending else F.asc(q.order_by), self.id)
        elif q.point is not None:
            rows = rows.orderBy("distance", self.id)
        if q.limit:
            rows = rows.limit(q.limit)
        return rows if "*" in q.fields else rows.select(*q.fields)

    def _range(self, q: Query) -> DataFrame:
        return self._select(replace(q, type=QueryType.SELECT))

    def _tangent(self, q: Query) -> DataFrame:
        if q.point is None:
            raise QueryError("a tangent query needs a point (NEAR [..] or the builder)")
        local = F.slice(F.col(q.column), 1, self.dim)
        rows = self._points(q).withColumn("distance", V.euclidean(local, F.slice(V.literal(q.point), 1, self.dim)))
        rows = search.top_k(rows, q.k, id_col=self.id)
        return rows if q.epsilon is None else rows.where(F.col("distance") <= q.epsilon)

    def _map(self, source: str, target: str):
        if (source, target) in self.transitions:
            matrix, bias = self.transitions[source, target]
            return lambda v: V.affine(V.matrix_literal(matrix), V.literal(bias), v)
        if source == target:
            return lambda v: v
        raise QueryError(f"no transition from {source!r} to {target!r}")

    def _cross_modal(self, q: Query) -> DataFrame:
        if q.point is None:
            raise QueryError("a cross-modal query needs a point (NEAR [..] or the builder)")
        moved = self._map(q.modality, q.target_modality)(V.literal(q.point))
        rows = self._points(q).where(F.col("modality") == q.target_modality)
        return search.top_k(rows.withColumn("distance", udfs.named(q.metric)(F.col(q.column), moved)), q.k, id_col=self.id)

    def _transport(self, q: Query) -> DataFrame:
        one = self.spark.range(1).select(F.lit(0).cast("long").alias(self.id), F.lit(0.0).alias("distance"))
        return one.withColumn("vector", self._map(q.source_chart, q.target_chart)(V.literal(q.vector)))

    def explain(self, q: Query) -> str:
        """The logical steps, then Spark's formatted plan."""
        lines = [f"{q.type.value} (cost tier: {q.cost().name.lower()})", *(f"  {i}. {s}" for i, s in enumerate(steps(q), 1))]
        plan = self.execute(q)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return "\n".join([*lines, "", plan])


def steps(q: Query) -> list[str]:
    """What the planner does, in order."""
    scan = f"scan {q.source}" + (f" where chart = {q.chart}" if q.chart else "")
    if q.type is QueryType.TRANSPORT:
        return [f"look up the transition {q.source_chart} -> {q.target_chart}", "apply it to the vector"]
    if q.type is QueryType.TANGENT:
        return [scan, "distance of tangent coordinates", f"top {q.k}", *([f"keep distance <= {q.epsilon}"] if q.epsilon is not None else [])]
    if q.type is QueryType.CROSS_MODAL:
        return [f"transport the point {q.modality} -> {q.target_modality} via {q.via}", f"{scan} where modality = {q.target_modality}", f"{q.metric} distance", f"top {q.k}"]
    out = [scan]
    if q.point is not None:
        out += [f"{q.metric} distance (closed form)", *([f"keep distance {q.operator} {q.epsilon}"] if q.epsilon is not None else []), f"order by {q.order_by or 'distance'}"]
    elif q.order_by:
        out.append(f"order by {q.order_by}")
    return out + ([f"limit {q.limit}"] if q.limit else []) + [f"project {', '.join(q.fields)}"]
