"""Numeric measures of arrays and texts.  Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_length(symbols: Column) -> Column:
    """Sum over distinct symbols of share * ceil(-log2(share)); 0 for an empty array, null for null.

    Counts are runs of the sorted array, so the cost is that of a sort and nothing is shuffled.
    """
    n = F.size(symbols)
    ordered = F.array_sort(symbols)
    state = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("total"))
    cost = lambda run: F.when(run > 0, F.ceil(F.log2(n / run)) * run / n).otherwise(0.0)
    step = lambda s, x: F.when(s["last"] == x, F.struct(s["last"].alias("last"), (s["run"] + 1).alias("run"), s["total"].alias("total"))).otherwise(F.struct(x.alias("last"), F.lit(1).alias("run"), (s["total"] + cost(s["run"])).alias("total")))
    return F.when(symbols.isNotNull(), F.aggregate(ordered.cast("array<string>"), state, step, lambda s: F.when(n > 0, s["total"] + cost(s["run"])).otherwise(0.0)))


def characters(text: Column) -> Column:
    """Characters of a text; an empty text has none."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(values: Column) -> Column:
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(shifted, lambda x: x / _sum(shifted))


def gini(values: Column) -> Column:
    """Gini coefficient; if the least value is negative, all are shifted to begin at 0."""
    low = F.least(F.array_min(values), F.lit(0.0))
    ordered = F.array_sort(F.transform(values, lambda x: x - low))
    n = F.size(values)
    return _sum(F.transform(ordered, lambda x, i: (2 * (i + 1) - n - 1) * x)) / (n * _sum(ordered))


def attention_entropy(weights: Column) -> Column:
    """-sum(w * ln(w + 1e-8))."""
    return -_sum(F.transform(weights, lambda w: w * F.ln(w + F.lit(1e-8))))


def perplexities(log_probabilities: Column) -> Column:
    """prompt, generation and sequence perplexity.  All three divide by the full count; an array that is empty or null gives -1."""
    n = F.size(log_probabilities)
    half = F.floor(n / 2).cast("int")
    of = lambda part: F.exp(-_sum(part) / n)
    triple = F.struct(of(F.slice(log_probabilities, 1, half)).alias("prompt"), of(F.slice(log_probabilities, half + 1, n)).alias("generation"), of(log_probabilities).alias("sequence"))
    return F.when(n > 1, triple).otherwise(F.struct(*(F.lit(-1.0).alias(x) for x in ("prompt", "generation", "sequence"))))


def parse_array(text: Column) -> Column:
    """'[a b c]' to array<double>."""
    inner = F.trim(F.regexp_replace(text, r"[\[\]]", ""))
    return F.when(inner == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, r"\s+"), lambda x: x.try_cast("double")))


def _runs(items: Column, goes_on) -> Column:
    """Runs of at least two items in which each pair of neighbours goes on."""
    state = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("n"))
    step = lambda s, x: F.when(goes_on(s["last"], x), F.struct(x.alias("last"), (s["run"] + 1).alias("run"), (s["n"] + (s["run"] == 1).cast("int")).alias("n"))).otherwise(F.struct(x.alias("last"), F.lit(1).alias("run"), s["n"].alias("n")))
    return F.aggregate(items.cast("array<string>"), state, step, lambda s: s["n"])


def increasing_runs(items: Column) -> Column:
    """Runs that increase as strings."""
    return _runs(items, lambda last, x: F.coalesce(x > last, F.lit(False)))


def non_increasing_runs(items: Column) -> Column:
    return _runs(items, lambda last, x: F.coalesce(x <= last, F.lit(False)))


def f1_score(p: Column, r: Column) -> Column:
    return F.try_divide(2 * p * r, p + r)


def f1_error(p: Column, r: Column, dp: Column, dr: Column) -> Column:
    """Propagated error of F1 from those of precision and recall."""
    return F.try_divide(F.lit(2.0), F.pow(p + r, 2)) * F.sqrt(F.pow(r, 4) * dp * dp + F.pow(p, 4) * dr * dr)


def percent_label(share: Column) -> Column:
    return F.concat((share * 100).cast("int").cast("string"), F.lit("%"))


def normalise(vector: Column) -> Column:
    """The vector over its length, as doubles."""
    v = vector.cast("array<double>")
    length = F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    return F.transform(v, lambda x: x / length)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))
