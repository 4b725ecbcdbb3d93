"""Repeated words and bytes against sets of all windows."""

import random

import numpy as np
import pytest

from echolot.llm import repeats, substring, suffixes
from echolot.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_rows import ODD, docs


def tangle(seed, n=60):
    """Texts of passages that recur whole, cut and shifted, also within a text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 90))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            lo = rng.randrange(len(p)) if rng.random() < 0.5 else 0
            parts.append(p[lo : lo + rng.randint(20, 400)] if rng.random() < 0.5 else word() + p)
        out.append(rng.choice(["\n", " ", ""]).join(parts))
    return list(enumerate(out)) + [(n + i, t) for i, t in enumerate(out[:5])]


def rows(spark, data):
    random.Random(0).shuffle(data)
    return spark.createDataFrame([(i, t, None) for i, t in data], "doc_id long, text string, body string")


def words_left(df):
    from pyspark.sql import functions as F

    return {tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()}


def bytes_left(df):
    from pyspark.sql import functions as F

    return {tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}


def test_queries(spark, sf):
    data = docs(spark, sf)
    assert {tuple(r) for r in QUERIES["op5_substring_dedup"](spark, sf).collect()} == brute.substring(data)
    assert {tuple(r) for r in QUERIES["op10_suffix_dedup"](spark, sf).collect()} == brute.suffix(data)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [repeats.HOT, 10])
def test_tangles(spark, seed, hot):
    data = tangle(seed)
    assert words_left(substring.remove_repeats(rows(spark, data), hot=hot)) == brute.substring(data)
    assert bytes_left(suffixes.remove_repeats(rows(spark, data), hot=hot)) == brute.suffix(data)


def test_odd_rows(spark):
    data = list(enumerate(ODD)) + [(50 + i, t) for i, t in enumerate(ODD)]
    table = rows(spark, data)
    assert words_left(substring.remove_repeats(table)) == brute.substring(data)
    assert bytes_left(suffixes.remove_repeats(table)) == brute.suffix(data)
    for made in (substring.remove_repeats(table.limit(0)), suffixes.remove_repeats(table.limit(0))):
        assert made.count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    twins = spark.createDataFrame([(1, text), (1, text), (1, text + " more"), (None, text), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(twins).collect()), key=str)
    assert [g for g in got if g[0] is None] == [(None, 0, 0), (None, 60, 60)]
    whole = [g for g in got if g[0] == 1]  # the rows of one id come in any order, but all after the first are repeats
    assert whole in ([(1, 60, 0), (1, 60, 60), (1, 61, 60)], [(1, 60, 60), (1, 60, 60), (1, 61, 0)])


def test_many_texts_under_one_id(spark):
    """Texts that share an id, also a null one, are told apart, whatever their hashes are."""
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    some = [text(26) for _ in range(3000)]
    data = [(None, t) for t in some] + [(7, t) for t in some[:5]] + [(3, text(30)) for _ in range(500)]
    rng.shuffle(data)
    table = spark.createDataFrame(data, "doc_id long, text string")
    words_gone = [(r.doc_id, r.n_removed) for r in substring.remove_repeats(table).collect()]
    assert sorted((i, n) for i, n in words_gone if i is not None) == sorted((i, 0) for i, _ in data if i is not None)
    assert sorted(n for i, n in words_gone if i is None) == [0] * 2995 + [26] * 5
    bytes_gone = [(r.doc_id, r.n_removed, r.n_bytes) for r in suffixes.remove_repeats(table).collect()]
    assert sum(n > 0 for _, n, _ in bytes_gone) == 5
    assert all(n == size for _, n, size in bytes_gone if n)


def test_hot_keys_by_join(spark, monkeypatch):
    """With no room for a list of hot anchors their stretches are found by a join."""
    monkeypatch.setattr(repeats, "HOT_LIST", 0)
    data = tangle(4)
    assert words_left(substring.remove_repeats(rows(spark, data), hot=10)) == brute.substring(data)
    assert bytes_left(suffixes.remove_repeats(rows(spark, data), hot=10)) == brute.suffix(data)


def test_keys_that_span_batches(spark):
    """A seed in very many contexts fills more than one Arrow batch and is hot or not."""
    rng = random.Random(8)
    word = lambda k: "".join(rng.choices("abcdefgh", k=k))
    phrase = " ".join(word(6) for _ in range(9))
    data = [(i, f"{' '.join(word(5) for _ in range(9))} {phrase} {' '.join(word(5) for _ in range(9))}") for i in range(600)]
    data += [(1000 + i, t) for i, (_, t) in enumerate(data[:7])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for hot in (100, repeats.HOT):
            assert words_left(substring.remove_repeats(rows(spark, data), hot=hot)) == brute.substring(data)
            assert bytes_left(suffixes.remove_repeats(rows(spark, data), hot=hot)) == brute.suffix(data)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cover():
    for a in range(suffixes.V):
        for b in range(suffixes.V):
            k = suffixes.SHIFT[a, b]
            assert k < suffixes.V and {(a + k) % suffixes.V, (b + k) % suffixes.V} <= set(suffixes.COVER)


def test_blockwise_sort(monkeypatch):
    """Small buckets, long ties: all suffixes of one text as stretches of one window."""
    monkeypatch.setattr(suffixes, "BUCKET", 64)
    rng = random.Random(5)
    text = bytes(rng.choices(b"ab", k=300)) * 3 + b"a" * 500 + bytes(rng.choices(b"abc", k=400))
    n = len(text) - 99
    data = b"".join(text[i : i + 100] for i in range(n))
    block = repeats.Block(np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64), np.frombuffer(data, np.uint8), np.arange(n + 1) * 100)
    seen, want = set(), []
    for i in range(n):
        want.append(text[i : i + 100] in seen)
        seen.add(text[i : i + 100])
    assert suffixes.resolver()(block).tolist() == want
