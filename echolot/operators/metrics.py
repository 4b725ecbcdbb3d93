"""Classification metrics as grouped aggregates and running sums over distinct scores.

Every function takes label (0 or 1) and score columns and optional group columns.  Rows are first reduced to one row for each
distinct score of a group; sums over the scores below are made over range partitions (ordering.py), so no group has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .ordering import dealt, next_values, sums_before


def _by_score(rows: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))


def _below(rows: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """keys, score, pos and neg of each distinct score, and how many of both are below it."""
    return sums_before(dealt(_by_score(rows, label, score, keys), keys, ["score"]), keys, ["score"], {"pos_below": "pos", "neg_below": "neg"})


def roc_auc(rows: DataFrame, label: str, score: str, *keys: str) -> DataFrame:
    """Area under ROC by mid-ranks: the share of (positive, negative) pairs in order, ties for half."""
    t = _below(rows, label, score, list(keys))
    won = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)
    return t.groupBy(*keys).agg(F.try_divide(F.sum(won), (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def _curve(rows: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """curve() with pos, the positives of each score."""
    t = written(_below(rows, label, score, keys), "scores")
    total = t.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    t = t.alias("a").join(total.alias("b"), same).select("a.*", "b.p", "b.n")
    t = t.select(*keys, "score", "pos", (F.col("p") - F.col("pos_below")).alias("tp"), (F.col("n") - F.col("neg_below")).alias("fp"), "p", "n")
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("p"))
    return t.select(*keys, "score", "pos", "p", "tp", "fp", precision.alias("precision"), recall.alias("recall"), F.try_divide(F.col("fp").cast("double"), F.col("n")).alias("fpr"), F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")).alias("f1"))


def curve(rows: DataFrame, label: str, score: str, *keys: str) -> DataFrame:
    """For each distinct score as threshold (>=): tp, fp, precision, recall, fpr and f1."""
    return _curve(rows, label, score, list(keys)).drop("pos", "p")


def average_precision(rows: DataFrame, label: str, score: str, *keys: str) -> DataFrame:
    """Step-wise sum of recall gains times precision (not the trapezoid)."""
    gain = F.try_divide(F.col("pos").cast("double"), F.col("p")) * F.col("precision")
    return _curve(rows, label, score, list(keys)).groupBy(*keys).agg(F.sum(gain).alias("average_precision"))


def area_under_precision_recall(rows: DataFrame, label: str, score: str, *keys: str) -> DataFrame:
    """Area under the precision-recall curve by trapezoids over recall, from recall 0 at precision 1."""
    k = list(keys)
    t = _curve(rows, label, score, k).withColumn("down", -F.col("score"))
    t = next_values(dealt(t, k, ["down"]), k, ["down"], {"next_recall": "recall", "next_precision": "precision"})
    step = (F.col("next_recall") - F.col("recall")) * (F.col("next_precision") + F.col("precision")) / 2
    top = F.max(F.struct("score", "recall", "precision"))  # closes the curve towards recall 0
    return t.groupBy(*keys).agg(F.sum(F.coalesce(step, F.lit(0.0))).alias("__s"), top.alias("__t")).select(*keys, (F.col("__s") + F.col("__t.recall") * (1 + F.col("__t.precision")) / 2).alias("pr_auc"))


def confusion(rows: DataFrame, label: str, predicted: str, *keys: str) -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted).cast("int") == 1
    t = rows.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def calibration_error(rows: DataFrame, label: str, score: str, bins: int = 5, *keys: str) -> DataFrame:
    """Expected calibration error of a two-class score over equal bins (lo, hi] of the larger probability."""
    confidence = F.greatest(F.col(score), 1 - F.col(score))
    # Of equal probabilities the first class is predicted.
    right = ((F.col(score) > 1 - F.col(score)).cast("int") == F.col(label)).cast("double")
    t = rows.select(*keys, confidence.alias("c"), right.alias("r")).withColumn("bin", F.ceil(F.col("c") * bins))
    t = t.groupBy(*keys, "bin").agg(F.avg("c").alias("c"), F.avg("r").alias("r"), F.count(F.lit(1)).alias("n"))
    return t.groupBy(*keys).agg((F.sum(F.abs(F.col("c") - F.col("r")) * F.col("n")) / F.sum("n")).alias("ece"))


def class_report(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1 and support of every category."""
    cells = rows.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).count()
    truth = cells.groupBy(F.col("l").alias("label")).agg(F.sum("count").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("count")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("p").alias("label")).agg(F.sum("count").alias("said"))
    t = truth.join(said, "label", "full").na.fill(0, ["support", "hit", "said"])
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    t = t.withColumns({"precision": ratio("hit", "said"), "recall": ratio("hit", "support")})
    return t.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).select("label", "precision", "recall", "f1", "support")


def log_loss(label: Column, score: Column, floor: float = 1e-15) -> Column:
    """Negative log likelihood of a row, the score kept off 0 and 1."""
    p = F.least(F.greatest(score.cast("double"), F.lit(floor)), F.lit(1 - floor))
    return -F.when(label == 1, F.ln(p)).otherwise(F.ln(1 - p))
