"""Shared helpers: text normalisation, lineage cuts, ranks, merged labels and hashes.

Column names that begin with two underscores are reserved for the operators of this subpackage.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
#: Id lists of at most so many rows (a few MB) may be broadcast.
SMALL_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; only where that is unset (local tests), one of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or Path(tempfile.mkdtemp(prefix="checkpoints-")).as_uri())
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint if the counted rows are within the limit; without it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based rank in the given total order, without sorting all rows in one task.

    Range-sorts, then adds to each row's number within its partition the sizes of earlier partitions;
    only one count per partition comes to the driver.
    """
    low = F.monotonically_increasing_id()
    sorted_rows = checkpointed(
        df.orderBy(*order).withColumn("__part", F.shiftright(low, 33)).withColumn("__row", low.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = sorted(tuple(r) for r in sorted_rows.groupBy("__part").count().collect())
    offsets, total = {}, 0
    for part, count in sizes:
        offsets[part] = total
        total += count
    offset = F.lit(0)
    if offsets:
        pairs = [F.lit(x).cast("long") for item in offsets.items() for x in item]
        offset = F.create_map(*pairs)[F.col("__part")]
    return sorted_rows.withColumn(name, F.col("__row") + offset).drop("__part", "__row")


def merged_labels(links: DataFrame) -> DataFrame:
    """(label, root) for the labels that links (u, v) join to a smaller one; root is the smallest label of a component.

    Every label hooks onto its smallest linked label, pointers are halved until they reach roots, and links are
    renamed by them, until none joins two roots. Each step is a grouped minimum or a join on one side's unique key,
    so a label with very many links never sits in one task; each round ends in a checkpoint.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = None
    while True:
        hooks = checkpointed(links.groupBy(F.col("u").alias("label")).agg(F.min("v").alias("root")))
        if found is None and not hooks.head(1):
            return hooks
        while True:
            upper = hooks.select(F.col("label").alias("__mid"), F.col("root").alias("__up"))
            stepped = hooks.join(upper, F.col("root") == F.col("__mid"), "left")
            hooks = checkpointed(stepped.select("label", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("moved")))
            if not hooks.where("moved").head(1):
                hooks = hooks.drop("moved")
                break
            hooks = hooks.drop("moved")
        if found is None:
            found = hooks
        else:
            later = hooks.select(F.col("label").alias("__mid"), F.col("root").alias("__up"))
            old = found.join(later, F.col("root") == F.col("__mid"), "left").select("label", F.coalesce("__up", "root").alias("root"))
            found = old.unionByName(hooks)
        for end in ("u", "v"):
            renamed = hooks.select(F.col("label").alias(end), F.col("root").alias("__root"))
            links = links.join(renamed, end, "left").withColumn(end, F.coalesce("__root", end)).drop("__root")
        links = checkpointed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        if not links.head(1):
            return found


def lean(run: Callable) -> Callable:
    """The same mapInArrow function, which at the end of a task gives the memory that it freed back to the system.

    Python workers stay for later tasks; what they keep would count against the executor while its JVM works.
    """

    @functools.wraps(run)
    def go(batches):
        yield from run(batches)
        give_back()

    return go


def lean_group(run: Callable) -> Callable:
    """The same for a function of one group's table, after each group."""

    def go(table):
        out = run(table)
        give_back()
        return out

    return go


def lean_cogroup(run: Callable) -> Callable:
    """The same for a function of two tables of a group."""

    def go(left, right):
        out = run(left, right)
        give_back()
        return out

    return go


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


# Vectorised hashing of words and shingles (numpy, 64 bits).

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=64)
def keys64(n: int, salt: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    start = np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start) | np.uint64(1)


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit hash for each word of lower-cased UTF-8 bytes, words being runs without ASCII white space."""
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(~SPACE[data])
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    size = 64
    while size < length.max():
        size *= 2
    letters = keys64(256, 11)[data[at]] * keys64(size, 12)[place]
    return mix64(np.add.reduceat(letters, first) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; with fewer words, of the whole sequence."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    factors, total = keys64(size, 13), np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total = total + words[j : n - width + 1 + j] * factors[j]
    return np.unique(mix64(total + np.uint64(width)))
