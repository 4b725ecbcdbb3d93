"""Many logistic regressions at once: one model for each category of each candidate taxonomy.

A candidate splits rows by two thresholds into three categories.  All models are fitted together by damped Newton steps: a pass over
the rows gives the losses, gradients and Hessians of all of them, as sums that tasks make by matrix products and Spark adds up.  So a
search takes as many passes as its slowest model has steps (tens), whatever the number of candidates; the driver holds the
weights, which grow with candidates and features only.  A last pass scores every candidate on other rows, each row by the model of its category.

Weights and penalty are those of modeling.train: n / (2 n_class) for a row of a class, and half the squared weights (without
intercept) over c.  Rows with a null or NaN among the features, thresholds or labels take no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows times models that are worked on at once in a task.
CELLS = 1 << 21
CATEGORIES = 3


@dataclass(frozen=True)
class Candidate:
    """Category 1: first >= t1; else 2: second >= t2; else 3."""

    name: str
    first: str
    t1: float
    second: str
    t2: float


def candidates(thresholds: list[tuple[str, float, float]], start: int = 0, end: int | None = None) -> list[Candidate]:
    """Ordered pairs of thresholds (feature, quantile, value) of different features; a checked slice of them."""
    every = [Candidate(f"{a[0]}-{a[1]}/{b[0]}-{b[1]}", a[0], a[2], b[0], b[2]) for a, b in itertools.permutations(thresholds, 2) if a[0] != b[0]]
    end = len(every) if end is None else end
    if not 0 <= start <= end <= len(every):
        raise ValueError(f"candidates {start} to {end} of {len(every)}")
    return every[start:end]


@dataclass
class Fits:
    """weights: candidate x category x (features, then intercept); NaN where a candidate has no model.  counts: rows of label 0 and 1."""

    candidates: list[Candidate]
    features: list[str]
    weights: np.ndarray
    counts: np.ndarray
    passes: int

    @property
    def eligible(self) -> np.ndarray:
        """Whether every category of a candidate has rows of both labels."""
        return (self.counts > 0).all(axis=(1, 2))

    def rows(self) -> list[tuple[str, int, str, float]]:
        """(candidate, category from 1, feature or "intercept", weight) of the eligible candidates."""
        names = [*self.features, "intercept"]
        return [(c.name, k + 1, f, float(w)) for i, c in enumerate(self.candidates) if self.eligible[i] for k in range(CATEGORIES) for f, w in zip(names, self.weights[i, k], strict=True)]


def _prepared(rows: DataFrame, features: list[str], found: list[Candidate], label: str) -> tuple[DataFrame, list[str]]:
    """One row of doubles (label, features, threshold columns) for each row without nulls, and the names of the threshold columns."""
    marks = sorted({x for c in found for x in (c.first, c.second)})
    values = F.array(F.col(label).cast("double"), *(F.col(f"`{c}`").cast("double") for c in (*features, *marks)))
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    return rows.select(values.alias("v")).where(good), marks


def _parts(batch: pa.RecordBatch, width: int, models: int) -> Iterator[np.ndarray]:
    x = batch.column(0)
    x = x.flatten().to_numpy().reshape(-1, width)
    step = max(1, CELLS // max(models, 1))
    for lo in range(0, len(x), step):
        yield x[lo : lo + step]


def _membership(found: list[Candidate], marks: list[str], values: np.ndarray) -> np.ndarray:
    """rows x (candidates * CATEGORIES): which category a row has in each candidate."""
    place = {m: i for i, m in enumerate(marks)}
    one = values[:, [place[c.first] for c in found]] >= np.array([c.t1 for c in found])
    two = values[:, [place[c.second] for c in found]] >= np.array([c.t2 for c in found])
    return np.stack([one, ~one & two, ~one & ~two], axis=2).reshape(len(values), -1)


def _sums(rows: DataFrame, models: int, width: int, make) -> np.ndarray:
    """models x width sums of what ``make`` gives for the arrays of a task; combined in tasks, then by model."""
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, width))
        for batch in batches:
            for x in make(batch):
                total += x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(models)), *(pa.array(c) for c in total.T)], names=["model", *names])

    got = rows.mapInArrow(run, "model long, " + ", ".join(f"{n} double" for n in names))
    table = got.groupBy("model").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((models, width))
    if table.num_rows:
        out[table.column("model").to_numpy()] = np.stack([table.column(n).to_numpy() for n in names], axis=1)
    return out


def fit_all(rows: DataFrame, features: list[str], found: list[Candidate], label: str = "label", c: float = 1.0, most_passes: int = 60, tolerance: float = 1e-9) -> Fits:
    """The models of every category of every candidate; rows are read once a pass, so callers write or cache what is costly to make."""
    data, marks = _prepared(rows, features, found, label)
    n_models, d = len(found) * CATEGORIES, len(features) + 1
    width = 1 + len(features) + len(marks)
    upper = np.triu_indices(d)

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels, features with a one for the intercept, and membership."""
        return x[:, 0], np.hstack([x[:, 1:d], np.ones((len(x), 1))]), _membership(found, marks, x[:, d:])

    def count(batch):
        for x in _parts(batch, width, n_models):
            y, _, member = split(x)
            yield np.stack([(1 - y) @ member, y @ member], axis=1)

    counts = _sums(data, n_models, 2, count)
    live = np.repeat((counts.reshape(-1, CATEGORIES, 2) > 0).all(axis=(1, 2)), CATEGORIES)
    per_class = np.where(live[:, None], counts.sum(axis=1, keepdims=True) / (2 * np.maximum(counts, 1)), 0.0)
    penalty = np.append(np.full(d - 1, 1 / c), 0.0)
    weights = np.zeros((n_models, d))

    def evaluate(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian of each model."""

        def make(batch):
            for x in _parts(batch, width, n_models):
                y, x, member = split(x)
                z = x @ weights.T
                s = member * np.where(y[:, None] == 1, per_class[:, 1], per_class[:, 0])
                p = 0.5 * (1 + np.tanh(z / 2))
                loss = (s * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0)
                pairs = x[:, upper[0]] * x[:, upper[1]]
                yield np.hstack([loss[:, None], (s * (p - y[:, None])).T @ x, (s * p * (1 - p)).T @ pairs])

        got = _sums(data, n_models, 1 + d + len(upper[0]), make)
        hessian = np.zeros((n_models, d, d))
        hessian[:, upper[0], upper[1]] = hessian[:, upper[1], upper[0]] = got[:, 1 + d :]
        return got[:, 0] + 0.5 * (penalty * weights**2).sum(axis=1), got[:, 1 : 1 + d] + penalty * weights, hessian + np.diag(penalty)

    loss, gradient, hessian = evaluate(weights)
    passes, done = 2, ~live
    step, length = np.zeros_like(weights), np.ones(n_models)
    fresh = ~done  # models whose step belongs to their current weights
    while not done.all() and passes < most_passes:
        step[fresh] = np.linalg.solve(hessian[fresh] + 1e-12 * np.eye(d), gradient[fresh][:, :, None])[:, :, 0]
        length[fresh] = 1.0
        trial = weights - np.where(done, 0.0, length)[:, None] * step
        new_loss, new_gradient, new_hessian = evaluate(trial)
        passes += 1
        # A model whose loss didn't fall tries half the step in the next pass, together with the others' next steps.
        better = ~done & (new_loss <= loss + 1e-10 * np.abs(loss))
        moved = np.abs(trial - weights).max(axis=1)
        weights[better], loss[better], gradient[better], hessian[better] = trial[better], new_loss[better], new_gradient[better], new_hessian[better]
        done |= (better & (moved <= tolerance * np.maximum(1.0, np.abs(weights).max(axis=1)))) | (length < 1e-8)
        length[~better] /= 2
        fresh = better & ~done
    weights[~live] = np.nan
    return Fits(found, features, weights.reshape(-1, CATEGORIES, d), counts.reshape(-1, CATEGORIES, 2), passes)


def score_all(fits: Fits, rows: DataFrame, label: str = "label", floor: float = 1e-15) -> list[tuple[str, float]]:
    """(candidate, mean log loss over the rows, each by the model of its category) of the eligible candidates, best first; one pass."""
    found = [c for i, c in enumerate(fits.candidates) if fits.eligible[i]]
    if not found:
        return []
    data, marks = _prepared(rows, fits.features, found, label)
    weights = fits.weights[fits.eligible].reshape(-1, fits.weights.shape[2])
    d = weights.shape[1]

    def make(batch):
        for x in _parts(batch, 1 + len(fits.features) + len(marks), len(weights)):
            y, member = x[:, :1], _membership(found, marks, x[:, d:])
            p = 0.5 * (1 + np.tanh((x[:, 1:d] @ weights[:, :-1].T + weights[:, -1]) / 2))
            p = np.clip(p, floor, 1 - floor)
            loss = np.where(member, -np.log(np.where(y == 1, p, 1 - p)), 0.0).sum(axis=0)
            yield np.stack([loss.reshape(-1, CATEGORIES).sum(axis=1), np.full(len(found), float(len(x)))], axis=1)

    got = _sums(data, len(found), 2, make)
    return sorted(((c.name, float(a / n)) for c, (a, n) in zip(found, got, strict=True) if n), key=lambda x: (x[1], x[0]))


def wald_all(fits: Fits, rows: DataFrame, label: str = "label") -> list[tuple[str, int, str, float]]:
    """(candidate, category, feature or "intercept", w**2 / se**2) from the information sum p (1 - p) x xT of all models; one pass."""
    data, marks = _prepared(rows, fits.features, fits.candidates, label)
    weights = np.nan_to_num(fits.weights.reshape(-1, fits.weights.shape[2]))
    d = weights.shape[1]
    upper = np.triu_indices(d)

    def make(batch):
        for x in _parts(batch, 1 + len(fits.features) + len(marks), len(weights)):
            member = _membership(fits.candidates, marks, x[:, d:])
            x = np.hstack([x[:, 1:d], np.ones((len(x), 1))])
            p = 0.5 * (1 + np.tanh(x @ weights.T / 2))
            yield (member * p * (1 - p)).T @ (x[:, upper[0]] * x[:, upper[1]])

    got = _sums(data, len(weights), len(upper[0]), make)
    information = np.zeros((len(weights), d, d))
    information[:, upper[0], upper[1]] = information[:, upper[1], upper[0]] = got
    variance = np.diagonal(np.linalg.pinv(information, hermitian=True), axis1=1, axis2=2)
    names = [*fits.features, "intercept"]
    return [(c.name, k + 1, f, float(weights[CATEGORIES * i + k, j] ** 2 / v)) for i, c in enumerate(fits.candidates) if fits.eligible[i] for k in range(CATEGORIES) for j, f in enumerate(names) if (v := variance[CATEGORIES * i + k, j]) > 0]


def as_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Results of a search (a few for each model) as a table."""
    return spark.createDataFrame(rows, schema)
