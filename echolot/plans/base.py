"""Shared inputs of the queries, in Spark and in SQL, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import token_ids
from ..scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if it has one."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores: a file of one row group is one task.  Tables of many splits stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def r9(c: Column) -> Column:
    """Doubles are compared after rounding, as sums are added in another order."""
    return F.round(c.cast("double"), 6)


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequence_id and all token ids of every document with text."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    return spread(texts).select(F.col("doc_id").alias("sequence_id"), token_ids(F.col("text")).alias("tokens"))


#: Tokens of a sequence, as the surveyed corpus has them, and what a document's id is multiplied by to number its sequences.
LENGTH, PIECES = 64, 1_000_000


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequence_id, doc_id and tokens: every document in consecutive sequences of 64 tokens, the last one with what is left.

    A written table, as the ids are hashes that several steps of a query read.
    """
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / LENGTH).cast("int")), lambda i: F.slice("tokens", i * LENGTH + 1, LENGTH))
    rows = tokenised(spark, sf_dir).select(F.col("sequence_id").alias("doc_id"), F.posexplode(pieces).alias("piece", "tokens"))
    return written(rows.select((F.col("doc_id") * PIECES + F.col("piece")).alias("sequence_id"), "doc_id", "tokens"), "sequences")


def memorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that are labelled as good; their sequences stand for memorized ones."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()


TOK = r"""tok AS (SELECT doc_id AS sequence_id, [('0x'||substr(md5(t),1,4))::INT FOR t IN string_split_regex(trim(text), '\s+')] AS tokens FROM documents WHERE text IS NOT NULL)"""
SEQ = TOK + f""", seq AS (SELECT doc_id * {PIECES} + i AS sequence_id, doc_id, tokens[{LENGTH} * i + 1:{LENGTH} * i + {LENGTH}] AS tokens FROM (SELECT sequence_id AS doc_id, tokens, unnest(range(0, (len(tokens) - 1) // {LENGTH} + 1)) AS i FROM tok))"""
MEM = """mem AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)"""
COUNTS = """counts AS (SELECT token_id, count(*) FILTER (m) AS memorized, count(*) FILTER (NOT m) AS non_memorized FROM (
  SELECT unnest(tokens) AS token_id, mem.doc_id IS NOT NULL AS m FROM seq LEFT JOIN mem USING (doc_id)) GROUP BY token_id)"""

#: Features of labelled documents: sums and remainders of table columns stand in for scores that need a neural model.
FEATURES = {
    "id": "d.doc_id",
    "label": "l.quality",
    "toxic": "l.toxic",
    "length": "CAST(d.n_chars AS DOUBLE)",
    "score": "CAST((d.n_chars * 37 + d.doc_id * 11) % 1000 AS DOUBLE) / 1000",
    "base_score": "CAST((d.n_chars * 17 + d.doc_id * 3) % 500 AS DOUBLE) / 500",
    "nl_score": "CAST((d.n_chars * 13 + d.doc_id * 7) % 1000 AS DOUBLE) / 1000",
    "duplicates": "(d.doc_id * 5 + d.n_chars) % 23",
    "templating": "CASE WHEN d.n_chars % 9 = 0 THEN 1 ELSE 0 END",
    "lang": "d.lang",
    "source": "d.source",
}
FRAME = "frame AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in FEATURES.items()) + " FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").alias("d"), table(spark, sf_dir, "labels").alias("l")
    return d.join(l, F.expr("d.doc_id = l.doc_id")).select(*(F.expr(v).alias(k) for k, v in FEATURES.items()))
