"""The corpus pipeline: quality rules, language, near duplicates, mixing and packing, each stage written and read again.

Every stage works on all rows that its predecessor kept. All but the last return the columns that they got, whatever these
are; an operator's own columns cannot clash with them, for a row travels as one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import jaccard, language, mixing, packing, quality
from harvestry.llm.store import Scratch
from harvestry.session import ship

#: Rows travel in this column.
ROW = "__row"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_row(docs), "doc_id", "text", "lang", "source")


def _row(docs: DataFrame):
    """All columns as one, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    return quality.quality(_rows(docs), keep=(ROW,), wide=True).where("kept").select(f"{ROW}.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    return language.identify(_rows(docs), keep=(ROW,), wide=True).where("kept").select(f"{ROW}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents with 0.8 of their five-word shingles in common."""
    return jaccard.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out until their sources have their weights, in a random order."""
    return mixing.mix(docs.select(_row(docs), "doc_id", "source")).select(f"{ROW}.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences."""
    return packing.pack(docs)


STAGES = [
    (name, lambda spark, docs, sf_dir, stage=stage: stage(ship(spark), docs, sf_dir))
    for name, stage in (("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing", mixture), ("packing", sequences))
]
#: SQL cannot express the second, third and fifth stage; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of sf_dir."""
    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(f"pipeline-{name}", stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
