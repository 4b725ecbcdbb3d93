"""Windows, the membership filter and exact gram counts against plain versions."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from echolot.functions import windows
from echolot.functions.sequences import HASH_BASE, HASH_MODULUS
from echolot.operators import duplicates, membership


def tokens(rng, n, kinds):
    return [list(map(int, rng.integers(0, kinds, rng.integers(0, 40)))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = tokens(rng, 60, 3) + [[1, 2, 3, 4] * 10] * 40 + [[]]
    return rows, spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)] + [(999, None, "x")], "sequence_id long, tokens array<int>, key string")


def test_window_keys_and_hashes():
    rng = np.random.default_rng(6)
    t = rng.integers(0, 1 << 17, 200)
    for n in (1, 2, 3, 5, 8, 31, 32):
        assert windows.polynomial_hashes(t, n).tolist() == [sum(int(x) * pow(HASH_BASE, k, HASH_MODULUS) for k, x in enumerate(t[i : i + n])) % HASH_MODULUS for i in range(len(t) - n + 1)]
        small = rng.integers(0, 2, 3000)
        grams = [tuple(small[i : i + n]) for i in range(len(small) - n + 1)]
        keys = windows.window_keys(small, n)
        assert len(keys) == len(grams) and len(set(zip(grams, keys.tolist(), strict=True))) == len(set(grams)) == len(set(keys.tolist()))
        assert not len(windows.window_keys(small[: n - 1], n)) and not len(windows.polynomial_hashes(small[: n - 1], n))
    thue = np.array([i.bit_count() % 2 for i in range(2048)])
    assert windows.window_keys(thue, 1024)[0] != windows.window_keys(1 - thue, 1024)[0]


@pytest.mark.parametrize("slice_bytes, scan_bytes", [(8 << 20, 64 << 20), (512, 1024)])
def test_membership(spark, slice_bytes, scan_bytes):
    """Every key passes in exactly one scan, and of others about one in a hundred."""
    keys = spark.range(3000).selectExpr("xxhash64(id) AS key")
    inside = np.array([r.key for r in keys.collect()])
    outside = np.random.default_rng(7).integers(-(1 << 62), 1 << 62, 200_000)
    found, false, n = np.zeros(len(inside), int), 0, 0
    for s in membership.scans(keys, slice_bytes, scan_bytes):
        found += s.passes(inside)
        false += s.passes(outside).sum()
        n += 1
        assert s.table.nbytes <= scan_bytes
    assert (found == 1).all() and n == (1 if slice_bytes > 1000 else 6)
    assert false / len(outside) < 0.02
    assert [s.table for s in membership.scans(keys, 512, 512, most=2)] == [None]
    assert not any(s.passes(inside).any() for s in membership.scans(keys.limit(0)))


def plain(rows, offset, n, drop_last=False):
    count = Counter(tuple(t[i : i + n]) for t in rows for i in range(len(t) - n + (0 if drop_last else 1)))
    return {i: count.get(tuple(t[offset : offset + n]), 1) if len(t) >= offset + n else 1 for i, t in enumerate(rows)}


@pytest.mark.parametrize("n", [4, 7])
def test_continuations(spark, corpus, n):
    rows, df = corpus
    got = {r.sequence_id: r.sequence_duplicates for r in duplicates.continuation_duplicates(df, offset=5, n=n).collect()}
    assert got == plain(rows, 5, n) | {999: 1}


def test_grams_that_share_a_key(spark, corpus):
    """With three keys for all grams the filter passes nearly everything, and tokens alone tell grams apart."""
    rows, df = corpus
    got = {r.sequence_id: r.sequence_duplicates for r in duplicates.continuation_duplicates(df, 5, 4, keys=lambda t, n: windows.window_keys(t, n) % np.uint64(3)).collect()}
    assert got == plain(rows, 5, 4) | {999: 1}


def test_filter_narrows_the_windows(spark):
    """Of 200000 windows the scan emits the wanted ones and about 1 % more."""
    rng = np.random.default_rng(8)
    rows = [(i, list(map(int, rng.integers(0, 60000, 231)))) for i in range(1000)]
    df = spark.createDataFrame(rows, "sequence_id long, tokens array<int>")
    wanted = duplicates.keyed_windows(df, 32, offset=32).select("key").distinct()
    passed = sum(duplicates.keyed_windows(df, 32, wanted=s).count() for s in membership.scans(wanted))
    assert 1000 <= passed <= 1000 + 0.02 * 199_000


def test_approximate_duplicates(spark, corpus):
    rows, df = corpus
    hashes = [(r.sequence_id, r.offset, r.gram_hash) for r in duplicates.gram_hashes(df, 5).collect()]
    assert sorted((i, o) for i, o, _ in hashes) == sorted((i, o) for i, t in enumerate(rows) for o in range(len(t) - 4))
    count = Counter(h for _, _, h in hashes)
    got = sorted(tuple(r) for r in duplicates.approximate_duplicates(df, 5, least=3).collect())
    assert got == sorted((h, count[h], i, o) for i, o, h in hashes if count[h] >= 3)


def test_guards(spark, corpus):
    for call in (lambda df: duplicates.gram_hashes(df, 0), lambda df: duplicates.continuation_duplicates(df, -1, 4), lambda df: duplicates.continuation_duplicates(df, 1, 0)):
        with pytest.raises(ValueError, match="windows of"):
            call(corpus[1])


def test_gram_totals(spark, corpus, monkeypatch):
    """Windows are counted in the scan; only those of ids with several rows are moved."""
    rows, df = corpus
    moved, table = [], duplicates.gram_table
    monkeypatch.setattr(duplicates, "gram_table", lambda s, n, drop_last=False: (moved.append({r.sequence_id for r in s.collect()}), table(s, n, drop_last))[1])
    grams = lambda t, n: [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]
    for n in (1, 4, 7):
        got = {tuple(r) for r in duplicates.gram_totals(df, n).collect()}
        assert got == {(i, len(g), len(set(g))) for i, t in enumerate(rows) if (g := grams(t, n))}
    assert moved == []
    more = spark.createDataFrame([(1, [1, 2, 1, 2, 3]), (1, [2, 3, 1]), (1, [5]), (None, [1, 2]), (None, [1, 2, 2]), (2, [7, 7, 7]), (3, [])], "sequence_id long, tokens array<int>")
    assert {tuple(r) for r in duplicates.gram_totals(more, 2).collect()} == {(1, 6, 4), (None, 3, 2), (2, 2, 1)}
    assert moved == [{1, None}]


def test_first_windows_of_rows_that_share_a_key(monkeypatch):
    rng = np.random.default_rng(9)
    (part,) = windows.parts(pa.array(tokens(rng, 50, 2)), 3)
    want = len({(r, *part.tokens[s : s + 3]) for r, s in zip(part.row.tolist(), part.start.tolist(), strict=True)})
    assert len(windows.first_of_row(part, 3)) == want
    plain = windows.window_keys
    monkeypatch.setattr(windows, "window_keys", lambda t, n: plain(t, n) % np.uint64(3))
    assert len(windows.first_of_row(part, 3)) == want
