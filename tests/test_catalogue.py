"""Every registered query with SQL gives DuckDB's rows; the others give what plain functions give, or hold what must hold."""

import math

import pytest
from pyspark.sql import functions as F

from echolot.catalogue import ORACLE_SQL, QUERIES
from echolot.functions import patterns
from echolot.plans.base import sequences, table
from tests import plain
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLE_SQL[name]) is None


@pytest.fixture(scope="module")
def tokens(spark, sf):
    return {r.sequence_id: list(r.tokens) for r in sequences(spark, sf).collect()}


def joined(items, by="_"):
    return by.join(map(str, items))


def rows(spark, sf, name):
    return {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, sf).collect()}


def test_patterns(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert rows(spark, sf, "pattern_detection") == {i: patterns.detect_pattern(t) or (None, None) for i, t in texts.items()}


def test_chunks(spark, sf, tokens):
    want = {i: plain.repeating_chunk(t) for i, t in tokens.items()}
    assert rows(spark, sf, "chunk_repetition") == {i: (joined(c), k) for i, (c, k) in want.items()}
    ratios = QUERIES["chunk_repetition_ratios"](spark, sf).collect()
    assert {r.k: r.n for r in ratios} == {k: sum(x == k for _, x in want.values()) for _, k in want.values()}
    assert all(math.isclose(r.ratio, r.n / len(want), abs_tol=1e-6) for r in ratios)


def test_repeated_sublist_ratios(spark, sf, tokens):
    got = {r.sequence_id: (r.n, r.occurrences, r.ratio) for r in QUERIES["repeated_sublist_ratios"](spark, sf).collect()}
    for i, t in tokens.items():
        sub = plain.longest_repeated_sublist(t)
        n = "".join(map(str, t)).count("".join(map(str, sub)))
        assert got[i][:2] == (len(sub), n) and math.isclose(got[i][2], len(sub) * n / len(t), abs_tol=1e-6)


def test_sublists_substrings_and_runs(spark, sf, tokens):
    subs = {i: plain.longest_repeated_sublist(t) for i, t in tokens.items()}
    assert rows(spark, sf, "repeated_sublists") == {i: (joined(s), len(s)) for i, s in subs.items()}
    assert rows(spark, sf, "frequent_substrings") == {i: (plain.most_frequent_substring(joined(t, "")),) for i, t in tokens.items()}
    runs = {i: patterns.longest_increasing_run([str(x) for x in t]) for i, t in tokens.items()}
    assert rows(spark, sf, "increasing_runs") == {i: (len(r), joined(r)) for i, r in runs.items()}


def test_metric_pipeline(spark, sf, tokens):
    got = QUERIES["metric_pipeline"](spark, sf).collect()
    assert {r.sequence_id: list(r.tokens) for r in got} == tokens
    single = {r.sequence_id: r for r in QUERIES["token_frequency_statistics"](spark, sf).collect()}
    for r in got:
        assert (r.is_incrementing, r.is_repeating) == patterns.detect_pattern(r.text)
        assert (list(r.repeating_chunk), r.repeating_k) == plain.repeating_chunk(list(r.tokens))
        assert r.sequence_duplicates >= 1 and len(r.text.split()) <= 64
        assert (r.max_frequency, r.min_frequency, r.p25_frequency) == tuple(single[r.sequence_id][c] for c in ("max_frequency", "min_frequency", "p25_frequency"))


def test_fitted_models(spark, sf):
    got = QUERIES["logistic_predictions"](spark, sf).collect()
    assert got and all(0 <= r.score <= 1 and r.predictions == (r.score > 0.5) or abs(r.score - 0.5) < 1e-3 for r in got)
    ids = {r.id for r in got}
    routed = QUERIES["routed_taxonomy_predictions"](spark, sf).collect()
    assert {r.id for r in routed} <= ids and all(0 <= r.model_score <= 1 for r in routed if r.model_score is not None)


def test_bootstrapped_divergence(spark, sf):
    """Mean and deviation over the replicates that plain numpy makes from the same draws."""
    import numpy as np

    from echolot.operators.sampling import poisson_weights
    from echolot.plans.base import frame
    from echolot.plans.evaluation import REPLICATES

    rows = frame(spark, sf).select(F.xxhash64("id").alias("h"), (F.col("duplicates") % 4).alias("bucket"), "score", "base_score").toPandas()
    got = {r.bucket: (r["mean"], r.sd) for r in QUERIES["bootstrapped_kl"](spark, sf).collect()}
    assert got.keys() == set(rows.bucket)
    for bucket, part in rows.groupby("bucket"):
        w = poisson_weights(part.h.to_numpy(), REPLICATES).astype(float)
        p, q = part.score.to_numpy() + 0.001, part.base_score.to_numpy() + 0.001
        p, q = w * p[:, None], w * q[:, None]
        p, q = p / p.sum(axis=0), q / q.sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            both = np.where(w > 0, (p - q) * np.log(p / q), 0).sum(axis=0) / 2
        assert np.allclose(got[bucket], (np.nanmean(both), np.nanstd(both)), atol=2e-6)


def test_bootstrap_sums(spark):
    """Sums of groups, a null one too, by fixed draws; a row for each group and replicate however many rows there are."""
    import numpy as np

    from echolot.operators import sampling

    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'big' WHEN id % 5 > 0 THEN concat('g', id % 7) END AS g", "IF(id % 11 = 0, null, id / 7.0) AS x", "id % 4 AS k").repartition(5)
    data = df.withColumn("h", F.xxhash64("id")).toPandas()
    got = {(r.g, r.k, r.replicate): (r.n, r.s) for r in sampling.bootstrap_sums(df, {"n": F.lit(1), "s": F.col("x")}, 50, "id", "g", "k").collect()}
    for (g, k), part in data.groupby(["g", "k"], dropna=False):
        w = sampling.poisson_weights(part.h.to_numpy(), 50)
        x = part.x.astype(float).fillna(0).to_numpy()
        for r in range(50):
            assert np.allclose(got[g if isinstance(g, str) else None, k, r], (w[:, r].sum(), w[:, r] @ x))
    assert len(got) == 50 * len(data.groupby(["g", "k"], dropna=False))
    whole = sampling.bootstrap_sums(df, {"n": F.lit(1)}, 1000, "id").toPandas()
    assert len(whole) == 1000 and abs(whole.n.mean() - 2000) < 10 and 35 < whole.n.std() < 55
    assert sampling.bootstrap_sums(df.limit(0), {"n": F.lit(1)}, 10, "id", "g").count() == 0


def test_taxonomy_search(spark, sf):
    """The best and some other candidates against single fits in numpy, and weights and Wald statistics for the same ones."""
    import numpy as np

    from echolot.plans.evaluation import _FEATURES, searched

    fits, f = searched(spark, sf)
    data = f.toPandas()
    found = {r.candidate: r.log_loss for r in QUERIES["taxonomy_search"](spark, sf).collect()}
    weights = {(r.candidate, r.category, r.feature): r.weight for r in QUERIES["taxonomy_weights"](spark, sf).collect()}
    wald = {(r.candidate, r.category, r.feature): r.wald for r in QUERIES["taxonomy_wald"](spark, sf).collect()}
    assert len(fits.candidates) == 108 and found and len(weights) == 15 * len(found)
    by_name = {c.name: c for c in fits.candidates}
    for name in [*sorted(found, key=found.get)[:3], *sorted(found)[:3]]:
        c = by_name[name]
        one, two = data[c.first] >= c.t1, data[c.second] >= c.t2
        total = n = 0
        for k, mask in enumerate((one, ~one & two, ~one & ~two), 1):
            x = np.hstack([data[_FEATURES].to_numpy(), np.ones((len(data), 1))])[mask]
            y, fold = data.label.to_numpy()[mask].astype(float), data.fold.to_numpy()[mask]
            a, b = x[fold > 0], y[fold > 0]
            s = np.where(b == 1, len(b) / (2 * b.sum()), len(b) / (2 * (1 - b).sum()))
            w = np.zeros(5)
            for _ in range(60):
                p = 1 / (1 + np.exp(-a @ w))
                w = w - np.linalg.solve((a.T * (s * p * (1 - p))) @ a + np.diag([1, 1, 1, 1, 0]), a.T @ (s * (p - b)) + np.append(w[:4], 0))
            assert np.allclose([weights[name, k, i] for i in [*_FEATURES, "intercept"]], w, atol=1e-4)
            p = 1 / (1 + np.exp(-a @ w))
            error = np.diag(np.linalg.pinv((a.T * (p * (1 - p))) @ a))
            assert all(math.isclose(wald[name, k, i], w[j] ** 2 / error[j], rel_tol=1e-3, abs_tol=1e-2) for j, i in enumerate([*_FEATURES, "intercept"]) if (name, k, i) in wald)
            p = 1 / (1 + np.exp(-x[fold == 0] @ w))
            total -= np.log(np.where(y[fold == 0] == 1, p, 1 - p)).sum()
            n += (fold == 0).sum()
        assert math.isclose(found[name], total / n, abs_tol=1e-4)


def test_all_queries_are_held():
    plain = {"pattern_detection", "chunk_repetition", "chunk_repetition_ratios", "repeated_sublists", "frequent_substrings", "increasing_runs", "metric_pipeline", "logistic_predictions", "routed_taxonomy_predictions", "bootstrapped_kl", "repeated_sublist_ratios", "taxonomy_search", "taxonomy_weights", "taxonomy_wald"}
    assert QUERIES.keys() == ORACLE_SQL.keys() | plain
