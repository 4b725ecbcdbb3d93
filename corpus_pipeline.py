"""The corpus pipeline: documents in, packed windows out.

Each stage works on all rows that the one before it kept.  Quality rules and near-duplicate removal drop rows, suffix dedup
cuts passages out of texts, mixing repeats or leaves out rows by their rates, packing returns the pieces of token windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echolot.llm import mixing, neardup, packing, quality, suffixes
from echolot.llm.queries import domain_labels, vocabulary_path
from echolot.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): that of the smallest id."""
    return neardup.deduplicate(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 100 bytes that start earlier."""
    return suffixes.deduplicate(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates of their domains say."""
    return mixing.mix_documents(docs, domain_labels(spark, sf_dir))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    return packing.pack(docs, vocabulary_path())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mix_domains", mix_domains), ("pack_windows", pack_windows)]

#: The mixing stage fits a model, which SQL can't express; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
