"""Line dedup by overlapping three-line windows.

A text is split at \\n. Every run of three lines is hashed (128 bits); a text of one or two lines is one window. Of
all places in the corpus that hold the same window, the first (smallest id, then line number) stays; every later
place marks its lines, marks of overlapping windows merge, and marked lines are removed. Windows of blank lines only
do not count. Lines are compared without white space at their ends; what stays is unchanged and joined by \\n.

A null text stays null and an empty one empty. A document is an id with a text (by its 64-bit hash): rows that repeat
both are the same place, so a repeated row is not a later place of itself, while different texts of one id, or without
id, are places of their own and never share marks. Null ids come before all others, texts of one id in the order of
their hashes. An empty table gives an empty result. Other columns are kept as they are, but n_lines and n_removed are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

LINES = 3


def window_keys(text: Column, size: int = LINES) -> Column:
    """Array with the md5 of each window, null where all its lines are blank."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))

    def keys(parts: Column) -> Column:
        def one(i):
            body = F.array_join(F.slice(parts, i, size), "\n")
            return F.when(F.length(F.replace(body, F.lit("\n"), F.lit(""))) > 0, F.unhex(F.md5(body)))

        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - (size - 1), F.lit(1))), one)

    # a one-element array binds the lines once
    return F.element_at(F.transform(F.array(lines), keys), 1)


def repeated_places(docs: DataFrame, id_col: str, text_col: str, size: int = LINES) -> DataFrame:
    """(__id, __hash, __lines): for each document with later places, the 0-based lines that they cover."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("__text"))
    places = texts.select("__id", "__hash", F.posexplode(window_keys(F.col("__text"), size)).alias("__at", "__key")).where("__key is not null")
    place = F.struct("__id", "__hash", "__at")
    first = places.groupBy("__key").agg(F.count("*").alias("__n"), F.min(place).alias("__first"))
    first = checkpointed(first.where("__n > 1").drop("__n"))
    later = places.join(first, "__key").where(~place.eqNullSafe(F.col("__first")))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("__at"), lambda at: F.sequence(at, at + size - 1)))))
    return later.groupBy("__id", "__hash").agg(covered.alias("__lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = LINES, drop_emptied: bool = False, counts: bool = True) -> DataFrame:
    """docs with later places removed from the text, plus, with counts, n_lines and n_removed (0 for null texts).

    drop_emptied leaves out documents of which no line with content stays but which had some.
    """
    marks = repeated_places(docs, id_col, text_col, size).withColumnsRenamed({"__id": "__mark_id", "__hash": "__mark_hash"})
    same = docs[id_col].eqNullSafe(F.col("__mark_id")) & (F.xxhash64(docs[text_col]) == F.col("__mark_hash"))
    joined = docs.join(marks, same, "left")
    lines = F.split(docs[text_col], "\n", -1)
    joined = joined.withColumn("__split", lines).withColumn("__count", F.when(F.col("__split").isNull(), 0).otherwise(F.size("__split")))
    stay = F.array_except(F.sequence(F.lit(0), F.col("__count") - 1), F.col("__lines"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("__split"), i)), "\n")
    marked = F.col("__lines").isNotNull() & (F.col("__count") > 0)
    joined = joined.withColumn("__new", F.when(marked, kept).otherwise(docs[text_col])).withColumn("__removed", F.when(marked, F.col("__count") - F.size(stay)).otherwise(0))
    if drop_emptied:
        joined = joined.where((F.col("__removed") == 0) | (F.length(F.regexp_replace("__new", r"[\x20\x09-\x0D]+", "")) > 0))
    added = {"n_lines": "__count", "n_removed": "__removed"} if counts else {}
    columns = [F.col("__new").alias(c) if c == text_col else docs[c] for c in docs.columns if c.lower() not in added or c == text_col]
    return joined.select(*columns, *[F.col(c).cast("long").alias(n) for n, c in added.items()])
