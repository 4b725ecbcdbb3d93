"""Batched logistic regressions against single fits, and the search against its definition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolot.operators import modeling, search
from echolot.operators.taxonomy import threshold_pair

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(900):
        a, b = rng.gauss(0, 1), rng.gauss(0, 2)
        y = int(rng.random() < 1 / (1 + math.exp(-(1.5 * a - 0.5 * b + (a > 0.5)))))
        data.append((i, a, b, float(i % 10), y))
    data += [(1000, None, 1.0, 2.0, 1), (1001, 1.0, float("nan"), 2.0, 0), (1002, 1.0, 1.0, 2.0, None)]
    return spark.createDataFrame(data, "id long, a double, b double, c double, label int").cache()


@pytest.fixture(scope="module")
def found():
    return search.candidates([("a", 0.5, 0.0), ("c", 0.3, 3.0), ("c", 0.9, 50.0), ("b", 0.5, 0.5)])


def category(c):
    return threshold_pair(F.col(c.first), c.t1, F.col(c.second), c.t2, ("1", "2", "3"))


def good(rows):
    return rows.where("a is not null and not isnan(b) and label is not null")


def test_weights_are_those_of_single_fits(rows, found):
    """Newton's own single fit in numpy to 1e-6, and Spark ML's to its tolerance."""
    fits = search.fit_all(rows, FEATURES, found)
    assert len(found) == 10 and fits.passes <= 20
    assert [c.name for c, e in zip(found, fits.eligible, strict=True) if not e] == [c.name for c in found if 50.0 in (c.t1, c.t2)]
    data = np.array([(r.a, r.b, r.c, r.label) for r in good(rows).collect()])
    for i, c in enumerate(found):
        if not fits.eligible[i]:
            assert np.isnan(fits.weights[i]).all()
            continue
        one, two = data[:, "abc".index(c.first)] >= c.t1, data[:, "abc".index(c.second)] >= c.t2
        for k, mask in enumerate((one, ~one & two, ~one & ~two)):
            x, y = np.hstack([data[mask, :2], np.ones((mask.sum(), 1))]), data[mask, 3]
            assert fits.counts[i, k].tolist() == [(y == 0).sum(), (y == 1).sum()]
            s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
            w, pen = np.zeros(3), np.array([1, 1, 0.0])
            for _ in range(50):
                p = 1 / (1 + np.exp(-x @ w))
                w = w - np.linalg.solve((x.T * (s * p * (1 - p))) @ x + np.diag(pen), x.T @ (s * (p - y)) + pen * w)
            assert np.allclose(fits.weights[i, k], w, atol=1e-6)
    model = modeling.train(good(rows).where(category(found[0]) == "1"), FEATURES)
    assert np.allclose(fits.weights[0, 0], [*model.coefficients.toArray(), model.intercept], atol=1e-3)


def test_scores_and_wald(rows, found):
    fits = search.fit_all(rows, FEATURES, found)
    scores = dict(search.score_all(fits, rows))
    assert list(scores.values()) == sorted(scores.values()) and len(scores) == fits.eligible.sum()
    data = good(rows).collect()
    for i, c in enumerate(found):
        if not fits.eligible[i]:
            continue
        total = 0.0
        for r in data:
            k = 0 if r[c.first] >= c.t1 else 1 if r[c.second] >= c.t2 else 2
            w = fits.weights[i, k]
            p = 1 / (1 + math.exp(-(w[0] * r.a + w[1] * r.b + w[2])))
            total -= math.log(p if r.label else 1 - p)
        assert math.isclose(scores[c.name], total / len(data), rel_tol=1e-9)
    wald = {(name, k, f): x for name, k, f, x in search.wald_all(fits, rows)}
    model = modeling.train(good(rows).where(category(found[0]) == "3"), FEATURES)
    for f, x in modeling.wald(model, good(rows).where(category(found[0]) == "3"), FEATURES):
        assert math.isclose(wald[found[0].name, 3, f], x, rel_tol=2e-2)


def test_odd_inputs(rows, found):
    assert not search.fit_all(rows.limit(0), FEATURES, found).eligible.any()
    assert search.score_all(search.fit_all(rows.where("label = 1"), FEATURES, found), rows) == []
    with pytest.raises(ValueError):
        search.candidates([("a", 0.5, 0.0)], 0, 1)
