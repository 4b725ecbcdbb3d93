"""Row filters over a stream of sequences, and counts of events in time windows.

The filters that look at one row, and the left joins with static feature tables, run on a stream as they are.  Statistics that
would need an explode and a regrouping use their array form with a literal vocabulary map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.frequencies import frequency_statistics_in_place
from ..plans.filters import FeatureSet, Filter, code_length, code_vs_natural_language, detokenize, highly_repetitive, incrementing_and_repeating, semantic_matches, sequence_duplicates

STATELESS: tuple[Filter, ...] = (detokenize, incrementing_and_repeating, sequence_duplicates, highly_repetitive, code_vs_natural_language, semantic_matches, code_length)


def sequence_stream(spark: SparkSession, path: str, files_a_trigger: int = 64) -> DataFrame:
    """New Parquet files of sequence_id, tokens as they come."""
    return spark.readStream.schema("sequence_id bigint, tokens array<int>").option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def stream_metrics(rows: DataFrame, features: FeatureSet, memorized: dict[int, int] | None = None, non_memorized: dict[int, int] | None = None) -> DataFrame:
    for f in STATELESS:
        rows = f(rows, features)
    return rows if memorized is None else frequency_statistics_in_place(rows, memorized, non_memorized or {})


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of values of each event type in tumbling windows; events later than the watermark are dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, exactly once, for what is there now."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
