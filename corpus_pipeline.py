"""The corpus pipeline: raw documents in, a cleaned and mixed training corpus out.

Each stage takes the documents that the one before kept, as Parquet, and one of the
operators of ``playbill.llm`` decides. All stages but the last return the columns
of ``documents``; the last adds the number of the copy. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.llm import decontam, lines, mixing, neardup, quality
from playbill.llm.queries import SEED, WEIGHTS, read
from playbill.llm.storage import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.passing(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long lines that at least five documents hold; ``n_chars`` is counted anew where lines went.

    No document goes, even if nothing of it is left: its text is empty then.
    """
    done, changed = lines.dedup_lines(docs), F.col("n_dropped") > 0
    counted = done.withColumn("n_chars", F.when(changed, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars")))
    return counted.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that of the smallest doc_id."""
    return neardup.drop_near_duplicates(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of what is left, each document as often as drawn, in random order."""
    return mixing.mix_sources(docs, WEIGHTS, seed=SEED).select(*COLUMNS, "copy", "n_copies")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
]

#: Benchmark decontamination measures edit distances, which SQL does not; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    space = Workspace(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return docs
