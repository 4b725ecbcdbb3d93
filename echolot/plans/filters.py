"""The metric pipeline: an ordered tuple of pure functions over sequences and a set of feature tables.

Nothing is registered at import time and nothing is shared between runs; a feature table that a run doesn't have gives null
columns.  Filters are lazy, so Spark plans all of them together; ``checkpoint_every`` cuts long lineages where that is wanted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures, patterns, repeats, sequences
from ..operators import frequencies
from ..scratch import cut


@dataclass(frozen=True)
class FeatureSet:
    """Feature tables by key; None: not available."""

    sequence_frequencies: DataFrame | None = None  # sequence_id, frequency
    memorized_token_frequencies: DataFrame | None = None  # token_id, frequency
    non_memorized_token_frequencies: DataFrame | None = None
    code_scores: DataFrame | None = None  # sequence_id, nl_scores
    snowclones: DataFrame | None = None  # sequence_id, 0_8_frequencies, 0_9_frequencies
    templates: DataFrame | None = None
    vocabulary: Column | None = None  # map of token id to text


Filter = Callable[[DataFrame, FeatureSet], DataFrame]


def _left(rows: DataFrame, table: DataFrame | None, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """columns: new name -> (column of the table, type)."""
    if table is None:
        return rows.withColumns({new: F.lit(None).cast(kind) for new, (_, kind) in columns.items()})
    return rows.join(table.select("sequence_id", *(F.col(f"`{old}`").alias(new) for new, (old, _) in columns.items())), "sequence_id", "left")


def detokenize(rows: DataFrame, features: FeatureSet) -> DataFrame:
    if features.vocabulary is None:
        return rows if "text" in rows.columns else rows.withColumn("text", sequences.sequence_key(F.col("tokens"), " "))
    return rows.withColumn("text", sequences.detokenize(F.col("tokens"), features.vocabulary))


def incrementing_and_repeating(rows: DataFrame, features: FeatureSet) -> DataFrame:
    return rows.withColumn("__p", patterns.pattern("text")).withColumns({c: F.col("__p")[c] for c in ("is_incrementing", "is_repeating")}).drop("__p")


def sequence_duplicates(rows: DataFrame, features: FeatureSet) -> DataFrame:
    return _left(rows, features.sequence_frequencies, {"sequence_duplicates": ("frequency", "long")})


def token_frequency_statistics(rows: DataFrame, features: FeatureSet) -> DataFrame:
    if features.memorized_token_frequencies is None or features.non_memorized_token_frequencies is None:
        whole = dict.fromkeys(("max_frequency", "min_frequency", "p25_frequency", "p75_frequency"), "long") | dict.fromkeys(("avg_frequency", "median_frequency"), "double") | {"frequencies": "array<bigint>"}
        return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in whole.items()})
    return frequencies.frequency_statistics(rows, features.memorized_token_frequencies, features.non_memorized_token_frequencies)


def highly_repetitive(rows: DataFrame, features: FeatureSet) -> DataFrame:
    """The chunk that the tokens repeat, and how often (-1: none)."""
    return rows.withColumn("__c", repeats.chunk("tokens")).withColumns({"repeating_chunk": F.col("__c")["chunk"], "repeating_k": F.col("__c")["k"]}).drop("__c")


def code_vs_natural_language(rows: DataFrame, features: FeatureSet) -> DataFrame:
    return _left(rows, features.code_scores, {"nl_scores": ("nl_scores", "double")})


def semantic_matches(rows: DataFrame, features: FeatureSet) -> DataFrame:
    for kind, table in (("snowclones", features.snowclones), ("templates", features.templates)):
        rows = _left(rows, table, {f"{t}_{kind}": (f"{t}_frequencies", "long") for t in ("0_8", "0_9")})
    return rows


def code_length(rows: DataFrame, features: FeatureSet) -> DataFrame:
    return rows.withColumn("huffman_coding_length", patterns.text_code_length("text"))


FILTERS: tuple[Filter, ...] = (detokenize, incrementing_and_repeating, sequence_duplicates, token_frequency_statistics, highly_repetitive, code_vs_natural_language, semantic_matches, code_length)


def run(rows: DataFrame, features: FeatureSet, filters: tuple[Filter, ...] = FILTERS, checkpoint_every: int = 0) -> DataFrame:
    """All filters in order.  sequence_id must be unique."""
    for k, f in enumerate(filters, 1):
        rows = f(rows, features)
        if checkpoint_every and k % checkpoint_every == 0:
            rows = cut(rows)
    return rows


def with_score(rows: DataFrame, scores: DataFrame | None = None, models: list[str] | None = None) -> DataFrame:
    """memorization_score: 1 for memories (no scores given), else a row for each model of a wide score table."""
    if scores is None:
        return rows.withColumn("memorization_score", F.lit(1.0))
    wide = scores.select("sequence_id", *(F.col(f"`{m}`").cast("double").alias(m) for m in models or []))
    long = wide.unpivot("sequence_id", [F.col(f"`{m}`") for m in models or []], "model", "memorization_score")
    return rows.join(long, "sequence_id", "left")
