"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
documents; the last returns the mix. run() writes each stage as Parquet into the shared folder and rereads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.llm import decontam, line_dedup, mixing, near_dedup, toxicity
from chartlake.llm.common import checkpoint_dir, crc_mod, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on labelled documents that are not held out and drops those that score 0.5 or more."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0))
    return toxicity.score_texts(docs, model, score_col="__score").where(F.col("__score") < 0.5).drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three-line windows; a document that loses all its text goes."""
    out = line_dedup.dedup_lines(docs, drop_emptied=True, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which one word in twenty or more lies in benchmark passages."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: words taken and training positions, sorted by the first position."""
    mixed = mixing.mix(docs)
    return mixed.where("taken > 0").select("doc_id", "size", "source_size", "target", "taken", "position", "positions")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The toxicity classifier is not expressible in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
