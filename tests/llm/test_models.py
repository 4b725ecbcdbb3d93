"""Exact search against brute force; the language model against its definitions."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from echolot.llm import lm, topk
from echolot.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_rows import ODD, docs


def test_top_k(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {tuple(r) for r in QUERIES["op7_exact_top_k"](spark, sf).collect()} == brute.nearest(rows)


@pytest.mark.parametrize("block", [100, topk.QUERY_BYTES])
def test_top_k_ties_and_odd_rows(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 8]) for i in range(400)]
    rows += [(400 + i, [0.25, 0.25, 0.0, -0.25]) for i in range(150)]
    rows += [(600, None), (650, [None, 1.0, 1.0, 1.0]), (700, [float("nan")] * 4), (750, [float("inf")] * 4)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, v int")
    got = topk.top_k(table, lambda i: i % 50 == 0, query_bytes=block)
    assert {tuple(r) for r in got.collect()} == brute.nearest(rows)
    assert topk.top_k(table.limit(0), lambda i: i % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, lambda i: i % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]


def test_top_k_of_negative_scores(spark):
    """A tight group of vectors far from the query scores least of all; and the bound must not rise above it."""
    rows = [(0, [100.0, 0.0])] + [(i, [-200.0, 100000.0]) for i in range(1, 7)] + [(10 + i, [-1000.0 - i / 8, 0.0]) for i in range(390)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(table, lambda i: i == 0).collect()}
    assert got == {r for r in brute.nearest(rows) if r[0] == 0}
    assert [r[2] for r in sorted(got)] == [1, 2, 3, 4, 5]


def test_top_k_mixed_lengths_and_large_values(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-9, 10, 3 + i % 3)]) for i in range(150)] + [(200, []), (250, [4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = set()
    for d in (3, 4, 5):
        want |= brute.nearest([r for r in rows if len(r[1]) == d])
    assert {tuple(r) for r in topk.top_k(table, lambda i: i % 50 == 0).collect()} == want
    large = [(i, [float(2**21 + x) for x in rng.integers(0, 3, 2)]) for i in range(60)]  # scores above 2**53 that differ by a few
    got = topk.top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0)
    assert {tuple(r) for r in got.collect()} == brute.nearest(large)


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_base_scores(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 300)
    monkeypatch.setattr(lm.frequent_words, "__defaults__", (300,))  # so that most words take the join
    rows = docs(spark, sf) + [(1000 + i, t) for i, t in enumerate(ODD)]
    tokens = {i: [*brute.words((t or "").translate(brute.LOWER)), None] for i, t in rows}
    count = Counter(x for i, w in tokens.items() if not held(i) for x in w)
    n, v = sum(count.values()), len(count)
    table = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int")
    got = {r.doc_id: r for r in lm.score(table).collect()}
    assert got.keys() == tokens.keys()
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    unseen = [r for r in got.values() if r.doc_id < 1000 and r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def tiny():
    count = np.array([50, 20, *range(100, 2, -1)])
    model = lm.Model(count, seed=1)
    rng = np.random.default_rng(2)
    for k in ("Wc", "Ww"):
        model.p[k] = (rng.standard_normal(model.p[k].shape) * 0.2).astype(np.float32)
    return model, rng


def test_model_is_a_distribution():
    model, rng = tiny()
    h = rng.standard_normal((5, lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(lm.log_probabilities(model, h, np.full(5, w))) for w in range(model.size))
    assert np.allclose(total, 1, atol=1e-4)


def test_gradients():
    model, rng = tiny()
    model.p = {k: x.astype(np.float64) for k, x in model.p.items()}
    x, y = rng.integers(0, model.size, (2, 4, 3))
    mask = np.ones((4, 3))
    mask[3, 1] = 0
    h0 = rng.standard_normal((3, lm.HIDDEN)) * 0.3
    g, _, _ = lm.gradients(model, x, y, mask, h0)
    for k, a in model.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), a.shape)
        old, e = a[at], 1e-5
        a[at] = old + e
        up = lm.gradients(model, x, y, mask, h0)[2]
        a[at] = old - e
        down = lm.gradients(model, x, y, mask, h0)[2]
        a[at] = old
        assert math.isclose((up - down) / (2 * e), g[k][at], rel_tol=1e-3, abs_tol=1e-6), k


def test_state_is_carried_across_windows(monkeypatch):
    model, rng = tiny()
    sizes = [1, 7, 200, 33, 64]
    first = np.concatenate(([0], np.cumsum(sizes)))
    ids = rng.integers(0, model.size, first[-1])
    whole = lm.score_documents(model, ids, first)
    monkeypatch.setattr(lm, "SCORE_WINDOW", 5)
    monkeypatch.setattr(lm, "SCORE_BATCH", 2)
    assert np.allclose(lm.score_documents(model, ids, first), whole, rtol=1e-4)


def test_every_training_document_is_learnt(spark):
    text = " ".join(["aa bb cc dd"] * 30)
    some = spark.range(400).selectExpr("id AS doc_id", "pmod(xxhash64(id), 16) AS k").where("k >= 3").collect()
    ids = {r.k: r.doc_id for r in some if not held(r.doc_id)}
    assert len(ids) == 13  # documents that training on three sixteenths would never see
    hashes = lm.tokens(next(lm.chunks(pa.array([text]))))[0]
    word, n = np.unique(hashes, return_counts=True)
    words, count = lm.lexicon(lm.Frequent(word, n, 1, int(n.sum()), len(word)))
    start = lm.Model(count).vector()
    for i in (ids[3], ids[9], None):
        docs = lm._prepared(spark.createDataFrame([(i, text)], "doc_id long, text string"), "doc_id", "text")
        assert not np.allclose(lm.fit(docs, words, count).vector(), start)


def test_scores_per_token():
    """A token takes fewer than half of the scores of two softmaxes of equal width, and no word is left out."""
    count = np.array([5_000_000, 100_000, *(10_000_000 // np.arange(10, 16_010))])
    model = lm.Model(count)
    target = np.sort(np.random.default_rng(5).choice(len(count), 20_000, p=count / count.sum()))
    cells = sum((rows.stop - rows.start) * (places.stop - places.start) for _, _, _, pieces in model.levels(target) for rows, places in pieces)
    assert cells / len(target) < math.sqrt(len(count))
    every = np.arange(len(count))
    assert np.allclose(np.exp(lm.log_probabilities(model, np.zeros((len(count), lm.HIDDEN), np.float32), every)), (count + 1) / (count.sum() + len(count)), rtol=1e-3)


@pytest.mark.parametrize("much", [200, -200])
def test_scores_that_overflow(much):
    model, rng = tiny()
    h = rng.standard_normal((50, lm.HIDDEN)).astype(np.float32)
    x, y = rng.integers(0, model.size, (2, 10, 5))
    want = lm.log_probabilities(model, h, y.ravel())
    grad = lm.gradients(model, x, y, np.ones(x.shape), h[:5] / 4)[0]
    for k in ("bc", "bw"):
        model.p[k] = model.p[k] + np.float32(much)  # softmax stays as it is
    assert np.allclose(lm.log_probabilities(model, h, y.ravel()), want, atol=1e-3)
    got = lm.gradients(model, x, y, np.ones(x.shape), h[:5] / 4)[0]
    assert all(np.allclose(got[k], grad[k], atol=1e-4) for k in grad)


def test_places_of_hashes():
    rng = np.random.default_rng(6)
    top = ~np.uint64(0)
    near = np.arange(1000, 1100, dtype=np.uint64)  # share their leading bits
    for word in (np.zeros(0, np.uint64), np.unique(np.concatenate((rng.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2), near))), np.array([0, top], np.uint64)):
        asked = np.concatenate((word, word + np.uint64(1), near, [np.uint64(0), top]))
        at, there = lm.Places(word).find(asked)
        assert (there == np.isin(asked, word)).all()
        assert (word[at[there]] == asked[there]).all()


def test_hashes_tell_words_apart():
    """Words of up to 8 bytes are hashed on their own: with zeros at the end, and beside longer ones that begin alike."""
    some = ["a", "a\0", "a\0\0", "\0", "b", "ab", "ba", "abcdefgh", "abcdefghi", "abcdefg", "abcdefg\0", "ä", "abcdefgh\0", "x" * 5000]
    got, first = lm.tokens(next(lm.chunks(pa.array([" ".join(some), " ".join(w.upper() for w in some if w.isascii()), None]))))
    assert len(set(got[: first[1]].tolist())) == len(some) + 1
    assert set(got[first[1] : first[2]].tolist()) < set(got[: first[1]].tolist())
    assert got[first[2] :].tolist() == [int(lm.END_HASH)]


def test_scores_do_not_depend_on_what_is_broadcast(spark, sf, monkeypatch):
    """Words beyond the frequent ones are outside the model's vocabulary like others, and share the unknown symbol's probability once."""
    monkeypatch.setattr(lm.lexicon, "__defaults__", (0.2,))
    monkeypatch.setattr(lm, "ROUNDS", 1)
    table = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").coalesce(1).localCheckpoint()
    want = {r.doc_id: r.score for r in lm.score(table).collect()}
    monkeypatch.setattr(lm.frequent_words, "__defaults__", (300,))
    got = {r.doc_id: r.score for r in lm.score(table).collect()}
    assert want.keys() == got.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-3) for i in want)
