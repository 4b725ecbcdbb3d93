"""Statistics whose sums Spark computes; only tails of distributions are evaluated on the driver, from a handful of numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import dealt, next_values, sums_before


def mid_ranks(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """value, rank and n for every distinct value: ties share their middle rank."""
    t = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    t = sums_before(dealt(t, list(keys), ["value"]), list(keys), ["value"], {"before": "n"})
    return t.select(*keys, "value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def pearson(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Null where a column is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return rows.groupBy(*keys).agg(F.try_divide(F.covar_pop(x, y), spread).alias("statistic"), F.count(F.lit(1)).alias("n"))


def spearman(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Pearson of mid-ranks."""
    out = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for name, rank in ((x, "__x"), (y, "__y")):
        ranks = mid_ranks(out, name, *keys).select(*keys, F.col("value").alias(name), F.col("rank").alias(rank))
        out = out.join(ranks, [*keys, name])
    return pearson(out, "__x", "__y", *keys)


def xi(rows: DataFrame, x: str, y: str, id: str, *keys: str) -> DataFrame:
    """Chatterjee's xi of y on x: 1 - n * sum|r(i+1) - r(i)| / (2 * sum l(i) * (n - l(i))), rows in order of x (ties by id).

    r counts rows with y <= y(i), l those with y >= y(i).  Null where y is constant.
    """
    k = list(keys)
    t = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"), F.col(id).alias("id"))
    by = t.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("m"))
    # Values of y are counted once; a group's n comes with the last sum.
    by = sums_before(dealt(by, k, ["y"]), k, ["y"], {"before": "m"}).select(*(F.col(c).alias(f"__{c}") for c in k), F.col("y").alias("__y"), (F.col("before") + F.col("m")).alias("r"), "before")
    same = F.col("y") == F.col("__y")
    for c in k:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    t = t.join(by, same).drop("__y", *(f"__{c}" for c in k))
    t = next_values(dealt(t, k, ["x", "id"]), k, ["x", "id"], {"next": "r"})
    # l = n - before, so sum l (n - l) = n sum before - sum before^2.
    n, b = F.count(F.lit(1)), F.col("before").cast("double")
    return t.groupBy(*keys).agg((1 - F.try_divide(n * F.sum(F.abs(F.col("next") - F.col("r"))).cast("double"), 2.0 * (n * F.sum(b) - F.sum(b * b)))).alias("statistic"), n.alias("n"))


def kl_divergence(rows: DataFrame, p: str, q: str, *keys: str) -> DataFrame:
    """KL(p, q), KL(q, p) and their mean for two positive columns, each normalised to sum 1 in its group."""
    t = rows.groupBy(*keys).agg(*(F.sum(c).alias(name) for name, c in kl_sums(p, q).items()))
    return kl_of_sums(t).select(*keys, "kl", "kl_reverse", "symmetric")


def kl_sums(p: str, q: str) -> dict[str, Column]:
    """Columns whose sums make up the divergence: sum(p/P ln(p/P : q/Q)) is sum(p ln(p/q)) / P - ln(P/Q), so partial sums do."""
    a, b = F.col(p).cast("double"), F.col(q).cast("double")
    return {"__a": a, "__b": b, "__ab": a * F.ln(a / b), "__ba": b * F.ln(b / a)}


def kl_of_sums(sums: DataFrame) -> DataFrame:
    """kl, kl_reverse and symmetric from the sums; null where a sum is zero, as in a replicate that drew nothing."""
    ratio = F.ln(F.try_divide("__a", "__b"))
    t = sums.withColumns({"kl": F.try_divide("__ab", "__a") - ratio, "kl_reverse": F.try_divide("__ba", "__b") + ratio})
    return t.withColumn("symmetric", (F.col("kl") + F.col("kl_reverse")) / 2).drop("__a", "__b", "__ab", "__ba")


def paired_sums(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """n, mean and sample deviation of a - b, and the t statistic."""
    d = F.col(a) - F.col(b)
    t = rows.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    return t.withColumn("t", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")))


def signed_rank(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Wilcoxon: n (differences that aren't 0), w_plus and w_minus by mid-ranks of |a - b|."""
    d = rows.select((F.col(a) - F.col(b)).alias("d")).where("d != 0").withColumn("size", F.abs("d"))
    ranks = mid_ranks(d, "size").select(F.col("value").alias("size"), "rank")
    t = d.join(ranks, "size")
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))


def chi2_tail(x: float) -> float:
    """P(chi-squared with one degree > x)."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def normal_tail(z: float) -> float:
    """P(|N(0, 1)| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|) with df degrees, by the incomplete beta function."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def correlation_pvalue(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson or Spearman correlation."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else math.nan
    return t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def likelihood_ratio(loss_without: float, loss_with: float) -> tuple[float, float]:
    """Statistic and p-value (one degree) from two sums of log losses."""
    x = 2 * (loss_without - loss_with)
    return x, chi2_tail(x)


def xi_pvalue(xi_value: float, n: int) -> float:
    """One-sided p-value of xi under independence: sqrt(n) * xi is about normal with variance 2/5."""
    return normal_tail(math.sqrt(n) * xi_value / math.sqrt(0.4)) / 2 if xi_value > 0 else 1 - normal_tail(math.sqrt(n) * xi_value / math.sqrt(0.4)) / 2


def signed_rank_pvalue(n: int, w_plus: float) -> float:
    """Two-sided p-value of Wilcoxon's statistic by its normal approximation."""
    if n == 0:
        return math.nan
    return normal_tail((w_plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def in_groups(rows: DataFrame, category: str, subset: str, whole: str = "all") -> DataFrame:
    """Every row once in its own (category, subset) and in the groups that stand for all, so that one grouped aggregate serves every cell."""
    both = [F.array(F.lit(whole), F.col(c).cast("string")) for c in (category, subset)]
    out = rows.withColumn("__categories", F.array_distinct(both[0])).withColumn("__subsets", F.array_distinct(both[1])).drop(category, subset)
    return out.withColumn(category, F.explode("__categories")).withColumn(subset, F.explode("__subsets")).drop("__categories", "__subsets")


def scaled_weights(weights: DataFrame) -> DataFrame:
    """(model, feature, weight) as a matrix of models by features, each feature standardised over the models (population deviation)."""
    w = Window.partitionBy("feature")
    deviation = F.stddev_pop("weight").over(w)
    scaled = (F.col("weight") - F.avg("weight").over(w)) / F.when(deviation == 0, 1.0).otherwise(deviation)
    return weights.withColumn("scaled", scaled).groupBy("model").pivot("feature").agg(F.first("scaled"))
