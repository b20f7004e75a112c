"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``.

Nulls: a null text is empty and fails the first stage; null ids, languages and sources are values of their own. Repeated rows
are copies of each other for line dedup and near-dedup. Further columns go along; one named like a result of an operator takes that
value, and one named ``_row`` goes. Empty tables give empty results. Every row keeps its number however a scan of its
file is split, so an executor lost between two scans of a stage changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nextdist.llm import linededup, mixing, neardup, packing, quality
from nextdist.llm.common import file_rows, saved


ROW = "_nextdist_row"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive limits; texts are read twice, not written."""
    return quality.quality_rules(docs, reread=True).where("kept").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; a document of which no word is left goes."""
    x = linededup.line_dedup(file_rows(docs, ROW), row=ROW).where("n_deleted = 0 or text rlike '[^ \\t\\n\\\\x0b\\\\x0c\\r]'")
    x = x.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return x.select(*[c for c in docs.columns if c in x.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts with a five-word Jaccard similarity of 0.8 or more."""
    return neardup.first_of_similar(file_rows(docs, ROW), row=ROW)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says."""
    return mixing.mixed(file_rows(docs, ROW), spark.read.parquet(f"{sf_dir}/labels.parquet"), row=ROW)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return packing.harmonic_packing(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near-dedup", near_dedup_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]
#: SQL has neither the minima's hash nor the tokenizer; tests/llm/test_pipeline.py holds run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
