"""Logistic regression over features with Spark ML, per taxonomy, and the search for a taxonomy."""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ordering
from .taxonomy import threshold_pair


@dataclass(frozen=True)
class Scaling:
    mean: dict[str, float]
    std: dict[str, float]

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: (F.col(c) - self.mean[c]) / self.std[c] for c in self.mean})


def fit_scaling(rows: DataFrame, features: list[str]) -> Scaling:
    """Mean and population deviation of every feature in one aggregate; a constant feature is divided by 1."""
    r = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
    return Scaling({c: r[f"m{i}"] or 0.0 for i, c in enumerate(features)}, {c: r[f"s{i}"] or 1.0 for i, c in enumerate(features)})


def drop_constant(rows: DataFrame, features: list[str]) -> list[str]:
    """Features with more than one value."""
    r = rows.agg(*((F.min(c) != F.max(c)).alias(f"d{i}") for i, c in enumerate(features))).first()
    return [c for i, c in enumerate(features) if r[f"d{i}"]]


def train(rows: DataFrame, features: list[str], label: str = "label", c: float = 1.0, iterations: int = 10_000) -> LogisticRegressionModel:
    """Balanced, L2-regularised logistic regression with intercept: weights n / (2 * n_class), penalty 1 / (C * n)."""
    per = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    n = sum(per.values())
    weight = F.lit(1.0)
    for y, k in per.items():
        weight = F.when(F.col(label) == y, n / (2.0 * k)).otherwise(weight)
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows.withColumn("weight", weight))
    return LogisticRegression(labelCol=label, weightCol="weight", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-10).fit(data)


def predict(model: LogisticRegressionModel, rows: DataFrame, features: list[str], threshold: float = 0.5, prefix: str = "") -> DataFrame:
    """Adds probs (of both classes) and predictions (strictly above the threshold)."""
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    probs = vector_to_array("probability")
    out = model.transform(data).withColumn(f"{prefix}prediction_probs", probs).withColumn(f"{prefix}predictions", probs[1] > threshold)
    return out.drop("features", "rawPrediction", "probability", "prediction")


def score_expression(model: LogisticRegressionModel, features: list[str]) -> Column:
    """P(1) as a plain expression, so that models can be chosen row by row without a pass for each."""
    z = F.lit(float(model.intercept))
    for name, w in zip(features, model.coefficients.toArray(), strict=True):
        z = z + F.col(name) * float(w)
    return 1 / (1 + F.exp(-z))


def routed_predictions(rows: DataFrame, taxonomy: str, models: dict[str, LogisticRegressionModel], features: list[str], threshold: float = 0.5) -> DataFrame:
    """Every row scored by the model of its category, in one projection."""
    p = F.lit(None).cast("double")
    for name, model in models.items():
        p = F.when(F.col(taxonomy) == name, score_expression(model, features)).otherwise(p)
    return rows.withColumn("model_score", p).withColumn("model_predictions", F.col("model_score") > threshold)


def weight_table(models: dict[str, LogisticRegressionModel], features: list[str]) -> list[tuple[str, str, float]]:
    return [(name, f, float(w)) for name, m in models.items() for f, w in zip(features, m.coefficients.toArray(), strict=True)]


def wald(model: LogisticRegressionModel, rows: DataFrame, features: list[str]) -> list[tuple[str, float]]:
    """(feature, w**2 / se**2) from the information matrix sum p(1 - p) x xT: k(k + 1) / 2 sums in one aggregate."""
    columns = {"intercept": F.lit(1.0)} | {f: F.col(f).cast("double") for f in drop_constant(rows, features)}
    p = score_expression(model, features)
    names = list(columns)
    pairs = list(itertools.combinations_with_replacement(range(len(names)), 2))
    got = rows.withColumn("__w", p * (1 - p)).agg(*(F.sum(F.col("__w") * columns[names[i]] * columns[names[j]]).alias(f"x{i}_{j}") for i, j in pairs)).first()
    info = np.zeros((len(names), len(names)))
    for i, j in pairs:
        info[i, j] = info[j, i] = got[f"x{i}_{j}"] or 0.0
    se2 = np.diag(np.linalg.pinv(info))
    w = {"intercept": float(model.intercept)} | {f: float(x) for f, x in zip(features, model.coefficients.toArray(), strict=True)}
    return [(f, w[f] ** 2 / se2[k] if se2[k] > 0 else float("nan")) for k, f in enumerate(names)]


def quantile_thresholds(rows: DataFrame, features: list[str], quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> list[tuple[str, float, float]]:
    """(feature, quantile, value), all features at once; the table is one group of any size."""
    got = {(r["column"], r["share"]): r["value"] for r in ordering.quantiles(rows, features, list(quantiles)).collect()}
    return [(c, q, got[c, q]) for c in features for q in quantiles if got.get((c, q)) is not None]


def taxonomy_candidates(thresholds: list[tuple[str, float, float]], start: int = 0, end: int | None = None) -> list[tuple[str, Column]]:
    """(name, expression) of ordered pairs of thresholds of different features; a checked slice of them."""
    every = [(a, b) for a, b in itertools.permutations(thresholds, 2) if a[0] != b[0]]
    end = len(every) if end is None else end
    if not 0 <= start <= end <= len(every):
        raise ValueError(f"candidates {start} to {end} of {len(every)}")
    return [(f"{a[0]}-{a[1]}/{b[0]}-{b[1]}", threshold_pair(F.col(a[0]), a[2], F.col(b[0]), b[2])) for a, b in every[start:end]]


def eligible(rows: DataFrame, taxonomy: Column, label: str, expected: list[str]) -> bool:
    """Whether every expected category has rows of both labels."""
    got = rows.groupBy(taxonomy.alias("t")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).collect()
    fine = {r.t for r in got if r.p and r.n}
    return set(expected) <= fine


def search_taxonomies(train_rows: DataFrame, test_rows: DataFrame, features: list[str], candidates: list[tuple[str, Column]], label: str = "label") -> list[tuple[str, float]]:
    """(name, log loss of the routed models on the test rows) of every eligible candidate, best first.

    Candidates are driver-side plans; the rows are cached by the caller once for all of them.
    """
    from .metrics import log_loss

    out = []
    for name, expression in candidates:
        if not eligible(train_rows, expression, label, ["taxonomy_1", "taxonomy_2", "taxonomy_3"]):
            continue
        t = train_rows.withColumn("__t", expression)
        models = {k: train(t.where(F.col("__t") == k), features, label, iterations=200) for k in ("taxonomy_1", "taxonomy_2", "taxonomy_3")}
        scored = routed_predictions(test_rows.withColumn("__t", expression), "__t", models, features)
        out.append((name, scored.agg(F.avg(log_loss(F.col(label), F.col("model_score")))).first()[0]))
    return sorted(out, key=lambda x: x[1])


def save_model(model: LogisticRegressionModel, path: str, features: list[str] | None = None, **metadata) -> None:
    """The model under path/model, and path/metadata with one JSON document: the weight of each feature, the intercept, and what else is given."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    weights = model.coefficients.toArray().tolist()
    document = {"weights": dict(zip(features or [f"x{i}" for i in range(len(weights))], weights, strict=True)), "intercept": float(model.intercept)} | metadata
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(path: str) -> tuple[LogisticRegressionModel, dict]:
    """The model and its metadata."""
    (line,) = SparkSession.active().read.text(f"{path}/metadata").collect()
    return LogisticRegressionModel.load(f"{path}/model"), json.loads(line[0])


def with_indicator(rows: DataFrame, taxonomy: str, categories: list[str]) -> DataFrame:
    """A 0/1 column for each category, as in models that take the taxonomy as features."""
    return rows.withColumns({f"is_{c}": (F.col(taxonomy) == c).cast("int") for c in categories})
