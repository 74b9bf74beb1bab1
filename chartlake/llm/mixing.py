"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1, piecewise linear between knots. Its integral up to t,
scaled to the source's target, is the source's cumulative token demand; a document that begins after c of the
source's taken words gets the time at which the demand reaches c. Documents are range-sorted by that position.

Targets share the total of all sizes by weight; none exceeds `max_epochs` times its source's size, and what is cut
is shared again by weight among the others. Within a source documents come in a seeded hash order, epoch after epoch,
and the target cuts the last one, so the words taken from a source differ from its target by rounding only.

Null or empty texts have size 0 and take nothing; a null source is a source of its own, after all others. Ties in
the order are broken by id and size; repeated rows are separate documents. An empty table gives an empty result.
Columns other than id, source and text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpointed, ranked

WEIGHTS = (1.0, 2.0, 3.0)
#: (time, multiplier) knots for each weight in turn: rising, level, falling.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))
DOCS_PER_SLICE = 8192


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """Adds weight, source_rank and target to one row per source (source, source_size).

    Water-filling: a source is cut where its share at the current level exceeds its cap; the level of the others
    rises until no more are cut. Each round brings two sums to the driver.
    """
    rows = ranked(sizes, [F.col("source").asc_nulls_last()], "source_rank")
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    rows = checkpointed(rows.withColumn("weight", choice).withColumn("cap", F.col("source_size") * float(max_epochs)))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, cut, n_cut = 0.0, F.lit(False), -1
    while True:
        fixed = F.when(cut, F.col("cap")).otherwise(0.0)
        free = F.when(cut, 0.0).otherwise(F.col("weight"))
        got = rows.agg(F.sum(fixed).alias("fixed"), F.sum(free).alias("free"), F.sum(cut.cast("int")).alias("n")).first()
        if got["n"] == n_cut or not got["free"]:
            break
        n_cut, level = got["n"], (total - got["fixed"]) / got["free"]
        cut = F.col("weight") * level > F.col("cap")
    return rows.withColumn("target", F.when(cut, F.col("cap")).otherwise(F.col("weight") * level)).drop("cap")


def demand_segments(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(t0, width, weight at t0, slope, demand before t0) of each segment, the demand over all time being 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        if t1 > t0:
            out.append((t0, t1 - t0, w0 / area, (w1 - w0) / area / (t1 - t0), before))
            before += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def inverse_demand(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integrated schedule reaches the share (0..1) of its whole demand."""
    segments = demand_segments(schedule)
    out = None
    for t0, _, w0, slope, before in segments:
        rest = share - before
        # root of slope/2 x^2 + w0 x = rest, in the form that stays exact for slope 0
        x = 2.0 * rest / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2.0 * slope * rest, F.lit(0.0))))
        value = F.when(rest <= 0, F.lit(t0)).otherwise(F.least(t0 + x, F.lit(1.0)))
        out = value if out is None else F.when(share >= before, value).otherwise(out)
    return F.lit(0.0) if out is None else out


def _times(schedule: Sequence[tuple[float, float]]):
    return lambda start: inverse_demand(start / F.col("target"), schedule)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    max_epochs: int = 3,
    seed: str = "mix-1",
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, epochs, position, positions.

    positions holds the training time (0..1) of each repetition, position the first (null if nothing is taken);
    rows are sorted by position, then source and id.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = checkpointed(source_targets(sources, weights, max_epochs))
    placed = rows.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    # Slices of the hash order keep a hot source's running sums out of one task.
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    n_slices = F.ceil(F.col("n_docs") / F.lit(DOCS_PER_SLICE))
    placed = placed.withColumn("slice", F.floor(spot * n_slices))
    sums = placed.groupBy("source_rank", "slice").agg(F.sum("size").alias("slice_size"))
    run = Window.partitionBy("source_rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("slice_size").over(run), F.lit(0))).drop("slice_size")
    inside = Window.partitionBy("source_rank", "slice").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("upto", F.sum("size").over(inside)).join(sums, ["source_rank", "slice"])
    whole = F.round("target").cast("long")
    start = F.col("before") + F.col("upto") - F.col("size")
    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    starts = F.transform(epochs, lambda e: e * F.col("source_size") + F.col("start"))
    placed = placed.withColumn("start", start).withColumn("whole", whole)
    placed = placed.withColumn("starts", F.when(F.col("size") > 0, F.filter(starts, lambda s: s < F.col("whole"))).otherwise(F.array().cast("array<bigint>")))
    taken = F.aggregate("starts", F.lit(0).cast("long"), lambda a, s: a + F.least(F.col("size"), F.col("whole") - s))
    choice = F.lit(None).cast("array<double>")
    for i, schedule in enumerate(schedules):
        times = F.transform("starts", _times(schedule))
        choice = F.when(F.col("source_rank") % len(schedules) == i, times).otherwise(choice)
    placed = placed.withColumn("taken", taken).withColumn("positions", choice)
    placed = placed.withColumn("position", F.when(F.size("positions") > 0, F.element_at("positions", 1)))
    out = placed.select(F.col("id").alias(id_col), F.col("source").alias("__source"), "size", "source_size", "target", "taken", F.size("starts").alias("epochs"), "position", "positions")
    return out.orderBy(F.col("position").asc_nulls_last(), F.col("__source").asc_nulls_last(), F.col(id_col)).drop("__source")
