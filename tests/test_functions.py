"""Golden values of the functions, and properties that must hold for any input."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolot.functions import measures, patterns, repeats, sequences
from echolot.operators import frequencies, metrics, stats
from tests import plain


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 2 3 4 5 6", (True, False)),
        ("0x1 0x2 0x3 0x4 0x5", (True, False)),
        ("A.1 , A.2 , A.3 , A.4", (True, False)),
        ("5 10 3", (True, False)),
        ("1 2 4", (False, False)),
        ("7 7 7 7 7 7", (False, True)),
        ("ababababab", (False, True)),
        ("aaaa", (False, True)),
        ("aaa", (False, False)),
        ("1 2", (False, False)),
        ("hello world foo bar", (False, False)),
        ("", (False, False)),
        ("9" * 5000 + " 1 2", (False, False)),
        (None, None),
    ],
)
def test_pattern(text, want):
    assert patterns.detect_pattern(text) == want


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_pattern_is_never_both(text):
    assert patterns.detect_pattern(text) != (True, True)


def test_repetition():
    assert plain.repeating_chunk([1, 2, 3, 4] * 3 + [1], 2, 4) == ([1, 2, 3, 4], 3)
    assert plain.repeating_chunk([1, 1, 1, 1]) == ([1, 1], 2)
    assert plain.repeating_chunk([1, 2, 3]) == ([], -1)
    assert plain.repeating_chunk([]) == ([], -1)
    assert plain.longest_repeated_sublist([1, 2, 1, 3, 1, 3, 1, 2, 1]) == [1, 2, 1]
    assert plain.longest_repeated_sublist([]) == []
    assert plain.most_frequent_substring("abab") == "ab"
    assert plain.most_frequent_substring("a") is None
    assert patterns.longest_increasing_run(["a1", "a2", "a3", "a1"]) == ["a1", "a2", "a3"]
    assert patterns.longest_increasing_run(["1", "x"]) == []


def plain_sublist(tokens):
    """The longest sublist that occurs again after its end, of several the one that begins first."""
    n = len(tokens)
    for size in range(n // 2, 0, -1):
        for i in range(n - size + 1):
            if any(tokens[j : j + size] == tokens[i : i + size] for j in range(i + size, n - size + 1)):
                return tokens[i : i + size]
    return []


@given(st.lists(st.integers(0, 2), max_size=24))
@settings(max_examples=300, deadline=None)
def test_longest_repeated_sublist(tokens):
    assert plain.longest_repeated_sublist(tokens) == plain_sublist(tokens)


@given(st.text("ab1", max_size=14))
@settings(max_examples=300, deadline=None)
def test_most_frequent_substring(text):
    subs = {text[i:j] for i in range(len(text)) for j in range(i + 2, len(text) + 1)}
    assert plain.most_frequent_substring(text) == min(subs, key=lambda s: (-text.count(s), -len(s), s), default=None)


def windows_of(lists):
    import numpy as np

    return repeats.Windows(np.array(sum(lists, []), np.int64), np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64))


@given(st.lists(st.lists(st.integers(0, 2), max_size=30), max_size=6), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_batched_repeats(lists, copies):
    """Several sequences at once, one of them periodic, give what the plain rules give one by one."""
    lists = [*lists, (lists[0] if lists else [1, 2]) * copies]
    w = windows_of(lists)
    for t, a, n in zip(lists, *repeats.longest_repeats(w), strict=True):
        assert t[a : a + n] == plain.longest_repeated_sublist(t)
    for t, n, k in zip(lists, *repeats.repeated_chunks(w), strict=True):
        assert (t[:n], k) == plain.repeating_chunk(t)
    for t, a, n in zip(lists, *repeats.most_frequent(w), strict=True):
        text = "".join(map(str, t))
        assert (text[a : a + n] or None) == plain.most_frequent_substring(text)


def test_repeats_of_long_sequences():
    """One item, one period, and no repeat, of a size at which anything quadratic would not end."""
    n = 200_000
    lists = [[7] * n, list(range(1000)) * (n // 1000), list(range(n)), []]
    w = windows_of(lists)
    assert [x.tolist() for x in repeats.longest_repeats(w)] == [[0, 0, 0, 0], [n // 2, n // 2, 0, 0]]
    assert [x.tolist() for x in repeats.repeated_chunks(w)] == [[n // 2, n // 2, 0, 0], [2, 2, -1, -1]]
    assert [x.tolist() for x in repeats.most_frequent(w)] == [[0, 0, 0, 0], [2, 1000, n, 0]]


def test_repeat_columns(spark):
    rows = spark.createDataFrame([(1, [1, 2, 1, 3, 1, 3, 1, 2, 1], "abab"), (2, None, None), (3, [], "a"), (4, [5, 5, 5, 5], "é😀é😀x"), (5, [1, None, 1, None], "")], "id int, t array<int>, s string")
    got = {r.id: (r.a, r.b and (r.b.chunk, r.b.k), r.c) for r in rows.select("id", repeats.repeated_sublist("t").alias("a"), repeats.chunk("t").alias("b"), repeats.frequent_substring("s").alias("c")).collect()}
    assert got == {1: ([1, 2, 1], ([], -1), "ab"), 2: (None, None, None), 3: ([], ([], -1), None), 4: ([5, 5], ([5, 5], 2), "é😀"), 5: ([1, None], ([1, None], 2), None)}


@given(st.text("ab", max_size=14))
@settings(max_examples=300, deadline=None)
def test_repeats_itself(text):
    assert patterns.repeats_itself(text) == patterns.periodic_step(list(text))[0]


def test_text_code_length(spark):
    texts = [None, "", "aaaa", "ab", "aab", "😀é😀", "x" * 1000 + "y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(patterns.text_code_length("t").alias("x"), measures.code_length(measures.characters(F.col("t"))).alias("y")).collect()
    for r in rows:
        assert r.x == r.y or math.isclose(r.x, r.y)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in _types(values)))
    return row.select(column.alias("x")).first().x


def _types(values):
    kinds = {int: "int", float: "double", str: "string"}
    for k, v in values.items():
        yield k, f"array<{kinds[type(v[0])] if v else 'int'}>" if isinstance(v, list) else kinds[type(v)]


@pytest.mark.parametrize(("text", "want"), [("aaaa", 0.0), ("ab", 1.0), ("abcd", 2.0), ("aab", 4 / 3), ("", 0.0)])
def test_code_length(spark, text, want):
    assert math.isclose(one(spark, measures.code_length(measures.characters(F.col("t"))), t=text), want)


def test_runs(spark):
    assert one(spark, measures.increasing_runs(F.col("t")), t=["1", "2", "3", "1", "2", "3"]) == 2
    assert one(spark, measures.increasing_runs(F.col("t")), t=["9", "10"]) == 0
    assert one(spark, measures.non_increasing_runs(F.col("t")), t=["1", "2", "3"] * 3) == 2


def test_hash_and_slices(spark):
    assert one(spark, sequences.polynomial_hash(F.col("t"), 3), t=[5, 7, 9]) == 32414461617
    assert one(spark, sequences.last_tokens(F.col("t"), 2), t=[1, 2, 3]) == [2, 3]
    assert one(spark, sequences.last_tokens(F.col("t"), 5), t=[1, 2, 3]) == [1, 2, 3]
    assert one(spark, F.size(sequences.ngrams(F.col("t"), 4)), t=[1, 2, 3]) == 0
    assert one(spark, F.size(sequences.ngrams(F.col("t"), 2, drop_last=True)), t=[1, 2, 3]) == 1
    assert one(spark, sequences.key_tokens(sequences.sequence_key(F.col("t"))), t=[1, 2, 3]) == [1, 2, 3]
    assert one(spark, measures.parse_array(F.col("t")), t="[1.5 2e-1  3]") == [1.5, 0.2, 3.0]
    assert one(spark, measures.percent_label(F.col("t")), t=0.257) == "25%"


def test_token_statistics(spark):
    rows = spark.createDataFrame([(1, [5, 7, 5, 9]), (2, []), (3, [7])], "sequence_id long, tokens array<int>")
    m, n = {5: 10, 7: 20}, {5: 1, 7: 2, 9: 3}
    tables = [spark.createDataFrame(list(x.items()), "token_id int, frequency long") for x in (m, n)]
    want = {1: ([11, 22, 11, None], 22, 44 / 3, 11.0, 11), 2: (None, None, None, None, None), 3: ([22], 22, 22.0, 22.0, 22)}
    for made in (frequencies.frequency_statistics(rows, *tables), frequencies.frequency_statistics(rows, *tables, most=1), frequencies.frequency_statistics_in_place(rows, m, n)):
        got = {r.sequence_id: (r.frequencies, r.max_frequency, r.avg_frequency, r.median_frequency, r.p25_frequency) for r in made.collect()}
        assert got == want


def test_token_statistics_look_up_and_join_alike(spark):
    """Random lists, nulls, repeated rows and further columns; the lookup moves no rows and keeps a null list's row."""
    rng = random.Random(9)
    lists = [[rng.randrange(40) for _ in range(rng.randrange(30))] for _ in range(300)]
    rows = spark.createDataFrame([(i, t, i % 7, "x") for i, t in enumerate(lists)] + [(1000, None, 1, None), (1001, [3, None, 4], 1, "y")], "sequence_id long, tokens array<int>, frequency int, position string")
    tables = [spark.createDataFrame([(t, rng.randrange(1, 100)) for t in range(start, 36)], "token_id int, frequency long") for start in (0, 5)]
    one, two = frequencies.frequency_statistics(rows, *tables), frequencies.frequency_statistics(rows, *tables, most=3)
    assert one.columns == two.columns and one.dtypes == two.dtypes
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan

    def seen(df):
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)

    assert seen(one) == seen(two)
    assert frequencies.frequency_statistics(rows.limit(0), *tables).count() == 0
    table = tables[0].withColumnRenamed("frequency", "occurrences").withColumn("unigram_perplexity", F.col("occurrences") / 7)
    assert seen(frequencies.sequence_extremes(rows, table, 5)) == seen(frequencies.sequence_extremes(rows, table, 5, most=3))
    nothing = tables[0].limit(0)
    assert {r.max_frequency for r in frequencies.frequency_statistics(rows, nothing, nothing).collect()} == {None}


def test_metric_properties(spark):
    rows = spark.createDataFrame([(i, i * 7 % 5 > 2, (i * 37 % 100) / 100) for i in range(200)], "id int, y boolean, s double").selectExpr("id", "int(y) AS y", "s", "1 - s AS r")
    auc = metrics.roc_auc(rows, "y", "s").first()[0]
    assert math.isclose(auc, 1 - metrics.roc_auc(rows, "y", "r").first()[0])
    assert 0 <= metrics.calibration_error(rows, "y", "s").first()[0] <= 1
    assert 0 < metrics.average_precision(rows, "y", "s").first()[0] <= 1
    constant = rows.withColumn("c", F.lit(1.0))
    assert stats.pearson(constant, "c", "y").first().statistic is None


def test_tails():
    assert math.isclose(stats.chi2_tail(3.841458820694124), 0.05, rel_tol=1e-6)
    assert math.isclose(stats.normal_tail(1.959963984540054), 0.05, rel_tol=1e-6)
    assert math.isclose(stats.t_tail(2.2281388519649385, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(stats.t_tail(12.706204736432095, 1), 0.05, rel_tol=1e-6)


def test_names(spark):
    from echolot.functions import names

    rows = spark.createDataFrame([("deduped.12b.71500",), ("duped.1.4b",), ("other",)], "s string")
    s = F.col("s")
    got = [tuple(r) for r in rows.select(names.model_size(s), names.checkpoint(s), names.parameters(names.model_size(s)), names.is_split(s)).collect()]
    assert got == [("12b", 0.5, 12e9, True), ("1.4b", 1.0, 1.4e9, True), (None, 1.0, None, False)]
    assert one(spark, names.display_name(F.col("s"), {"a": "Alpha"}), s="token_count") == "Token Count"
    assert tuple(one(spark, names.metric_key(F.col("s")), s="model_recitation_pr_auc")) == ("model", "recitation", "pr_auc")


def test_adapters(spark):
    from echolot.operators import adapters

    def make():
        return lambda batch: batch.assign(score=batch["x"] * 2.0)[["x", "score"]]

    rows = spark.range(10).withColumnRenamed("id", "x")
    assert adapters.score_batches(rows, make, "x long, score double").agg(F.sum("score")).first()[0] == 90
    assert one(spark, adapters.mean_dependency_distance(F.col("h")), h=[1, 1, 0]) == 1.0


def test_models(spark, tmp_path):
    import numpy as np

    from echolot.operators import modeling

    rng = np.random.default_rng(0)
    data = [(float(a), float(b), int(a + 0.5 * rng.standard_normal() > 0)) for a, b in rng.standard_normal((400, 2))]
    rows = spark.createDataFrame(data, "a double, b double, label int").cache()
    model = modeling.train(rows, ["a", "b"])
    out = modeling.predict(model, rows, ["a", "b"])
    assert out.where((F.col("label") == 1) == F.col("predictions")).count() > 320
    x = np.array([r[:2] for r in data])
    y = np.array([r[2] for r in data])
    w = np.append(model.coefficients.toArray(), model.intercept)
    p = 1 / (1 + np.exp(-(x @ w[:2] + w[2])))
    weight = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    assert np.abs(x.T @ (weight * (p - y)) + w[:2]).max() < 1e-3  # gradient of the penalised loss with C = 1
    wald = dict(modeling.wald(model, rows, ["a", "b"]))
    assert wald["a"] > 50 > wald["b"]
    modeling.save_model(model, str(tmp_path / "m"), ["a", "b"], taxonomy="all")
    again, document = modeling.load_model(str(tmp_path / "m"))
    assert again.intercept == model.intercept == document["intercept"] and document["taxonomy"] == "all"
    assert document["weights"] == dict(zip("ab", model.coefficients.toArray().tolist(), strict=True))
    thresholds = modeling.quantile_thresholds(rows, ["a", "b"])
    assert len(modeling.taxonomy_candidates(thresholds)) == 18
    with pytest.raises(ValueError, match="candidates"):
        modeling.taxonomy_candidates(thresholds, 0, 19)
    found = modeling.search_taxonomies(rows, rows, ["a", "b"], modeling.taxonomy_candidates(thresholds, 0, 2))
    assert all(0 < loss < 2 for _, loss in found)
