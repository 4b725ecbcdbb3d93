"""The operators over the given tables, as registered queries."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, lexical, lm, mixing, neardup, packing, periods, quality, simhash, sql, substring, suffixes, topk, warc


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Vocabulary files lie in the folder ECHOLOT_TOKENIZERS names, or else where their package has them."""
    if folder := os.environ.get("ECHOLOT_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(_table(spark, sf_dir, "documents")).drop("rejected_by")


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


def op3_mixture_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.document_rates(_table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir))
    return rates.select("doc_id", "n_tokens", *(F.round(F.col("p")[k], 6).alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)), F.round("rate", 6).alias("rate"), "copies")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(spark, _table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


#: The conversation that the contract adds.
EXTRA_TURN = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TURN).alias("text"))
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op9_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path())


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(_table(spark, sf_dir, "documents"), source=periods.splice)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_duplicates, op2_quality_cascade, op3_mixture_rates, op4_lm_score, op5_substring_dedup, op6_warc_captures, op7_exact_top_k, op8_chat_format, op9_pack_windows, op10_suffix_dedup, op11_simhash, op12_ranked_search, op13_periodic_runs)}
#: The mixture fit, the language model, the tokenizer and XXH64 can't be said in SQL; they are held by tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": sql.NEAR_DUPLICATES,
    "op2_quality_cascade": sql.QUALITY,
    "op5_substring_dedup": sql.SUBSTRING,
    "op6_warc_captures": sql.WARC,
    "op7_exact_top_k": sql.TOP_K,
    "op8_chat_format": sql.CHAT,
    "op10_suffix_dedup": sql.SUFFIX,
    "op12_ranked_search": sql.LEXICAL,
    "op13_periodic_runs": sql.RUNS,
}
