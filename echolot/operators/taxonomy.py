"""Labels and categories as expressions with stated thresholds and comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECITATION, RECONSTRUCTION, RECOLLECTION = "recitation", "reconstruction", "recollection"


def at_least(value: Column, threshold: float, strict: bool = False) -> Column:
    """value >= threshold (or >); a null value is not."""
    return F.coalesce(value > threshold if strict else value >= threshold, F.lit(False))


def is_templating(incrementing: Column, repeating: Column) -> Column:
    return (F.coalesce(incrementing, F.lit(False)) | F.coalesce(repeating, F.lit(False))).cast("int")


def memorization_taxonomy(duplicates: Column, templating: Column, threshold: float = 6, strict: bool = False) -> Column:
    return F.when(at_least(duplicates, threshold, strict), RECITATION).when(templating != 0, RECONSTRUCTION).otherwise(RECOLLECTION)


def report_category(score: Column, duplicates: Column, templating: Column, threshold: float = 5) -> Column:
    """Not Memorized comes first, whatever the duplicates."""
    return F.when(~at_least(score, 1.0), "Not Memorized").when(at_least(duplicates, threshold, strict=True), "Recite").when(templating != 0, "Reconstruct").otherwise("Recollect")


def threshold_pair(first: Column, t1: float, second: Column, t2: float, names: tuple[str, str, str] = ("taxonomy_1", "taxonomy_2", "taxonomy_3"), strict: bool = False) -> Column:
    return F.when(at_least(first, t1, strict), names[0]).when(at_least(second, t2, strict), names[1]).otherwise(names[2])


def code_type(nl_score: Column, code_most: float = 0.4, nl_least: float = 0.525) -> Column:
    return F.when(nl_score <= code_most, "Code").when(nl_score >= nl_least, "NL").otherwise("Uncertain")


def stratify_key(label: Column, taxonomy: Column) -> Column:
    return F.concat(label.cast("string"), taxonomy)
