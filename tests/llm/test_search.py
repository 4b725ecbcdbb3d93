"""SimHash, ranked search and periodic runs against plain versions, on the tables, on odd rows and on random ones."""

import hashlib

import numpy as np
import pytest
import xxhash

from echolot.llm import lexical, periods, simhash, textops
from echolot.llm.queries import QUERIES
from tests.llm import brute

ODD = [
    None, "", " \n", "one", "two words", "A b C", "a B c", "x " * 3000, "日本語 テスト 😀😀 é É", "word" * 2000, "a-b_c'd 12x!", "\x00\x7f", "a b a b a b a b a b c",
    "the cat sat on the mat and " * 40, "very long " + "abc def ghi jkl " * 20000, "p q r s p q r s p q r s p q r s", "a a a a a", "a a a a a a",
]
ODD_DOCS = [(i, t) for i, t in enumerate(ODD)] + [(3, "two words"), (3, "one"), (None, "no id here"), (None, None), (10, "the cat sat")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in ODD_DOCS], "doc_id long, text string, fp string, place int, `n.m` string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_range_hash():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 1 << 16).astype(np.uint8)
    size = np.append(rng.integers(0, 100, 3000), rng.integers(0, 9000, 30))
    start = rng.integers(0, len(data) - size + 1)
    want = [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(start, size, strict=True)]
    assert textops.range_hash(data, start, start + size).tolist() == want
    one, other = "a", "b"
    for _ in range(13):
        one, other = one + other, other + one
    both = np.frombuffer((one + other).encode(), np.uint8)
    assert len(set(textops.range_hash(both, np.array([0, len(one)]), np.array([len(one), len(both)])).tolist())) == 2


def test_simhash(spark, sf):
    assert rows(QUERIES["op11_simhash"](spark, sf)) == sorted(brute.simhash(documents(spark, sf)), key=str)


def test_simhash_odd_rows(spark, odd):
    got = rows(simhash.near_duplicates(odd))
    known = [(i, t) for i, t in ODD_DOCS if i is not None]
    # Rows that share an id are tied, so a plain version may take them as one more link.
    prints = [(i, brute.fingerprint(t)) for i, t in known]
    group = {i: i for i, _ in prints}
    for _ in prints:
        for i, f in prints:
            for j, g in prints:
                if i == j or (f ^ g).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    want = [(i, f"{f:016x}", group[i]) for i, f in prints] + [(None, f"{brute.fingerprint(t):016x}", None) for i, t in ODD_DOCS if i is None]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("most", [16, 4096])
def test_links_of_fingerprints(spark, most):
    """Crowds about some centres, of more nodes than a group may have, and strangers; small groups are dealt out again and again."""
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.int64).view(np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centre for k in rng.integers(0, 6, 100)]
    prints = sorted({*near, *(int(x) for x in rng.integers(0, 1 << 63, 200)), *range(64), (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most=most)
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges.collect():
        assert ((r.u ^ r.v) & ((1 << 64) - 1)).bit_count() <= 64
        root[find(r.u)] = find(r.v)
    whole = {x: x for x in prints}
    for _ in range(64):
        before = dict(whole)
        for i, x in enumerate(prints):
            for y in prints[:i]:
                if (x ^ y).bit_count() <= 3 and whole[x] != whole[y]:
                    whole[x] = whole[y] = min(whole[x], whole[y])
        if before == whole:
            break
    groups = {}
    for x, s in zip(prints, signed, strict=True):
        groups.setdefault(whole[x], set()).add(find(s))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_gray_order():
    code = np.arange(256, dtype=np.uint64)
    assert simhash.gray_rank(code ^ (code >> np.uint64(1))).tolist() == code.tolist()
    for mask in (0, 0xFF, (1 << 64) - 16):
        parts = simhash.split_mask(mask, 4)
        assert all(p & mask == mask for p in parts) and sum(p & ~mask for p in parts) == (1 << 64) - 1 - mask


def test_search(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(QUERIES["op12_ranked_search"](spark, sf)) == brute.lexical(documents(spark, sf), items)


ITEMS = [(1, "the cat, the MAT!"), (2, None), (3, "zzz"), (4, "É 日本語 abc"), (5, "a b c"), (5, "one"), (6, "x " * 50), (None, "two words"), (7, "no id here")]


@pytest.mark.parametrize("rows_broadcast", [lexical.ITEM_ROWS, 0])
def test_search_odd_rows(spark, odd, monkeypatch, rows_broadcast):
    monkeypatch.setattr(lexical, "ITEM_ROWS", rows_broadcast)
    items = spark.createDataFrame([(i, t, "clash", 1) for i, t in ITEMS], "item_id long, text string, term string, score int")
    copies = odd.union(odd.where("doc_id in (13, 5)").selectExpr("doc_id + 100", "text", "fp", "place", "`n.m`"))
    many = spark.range(200, 240).selectExpr("id", "'the cat sat on the mat and ran'", "''", "1", "''")
    docs = copies.union(many)
    want = brute.lexical([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert rows(lexical.search(docs, items)) == want
    assert rows(lexical.search(docs, items, k=2)) == [x for x in want if x[1] <= 2]
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_terms_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(lexical, "range_hash", lambda data, start, end: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"ab cd ef ab", np.uint8)
    assert lexical.Vocabulary(["ab", "xy", "ef"]).find(data, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])).tolist() == [0, -1, 2, 0]


def test_runs(spark, sf):
    assert rows(QUERIES["op13_periodic_runs"](spark, sf)) == sorted((brute.runs(i, t) for i, t in documents(spark, sf)), key=str)


def test_runs_odd_rows(spark, odd):
    short = odd.where("length(text) < 10000 or text is null")
    got = rows(periods.run_digests(short, source=periods.splice))
    assert got == sorted((brute.runs(r.doc_id, r.text) for r in short.collect()), key=str)
    assert periods.run_digests(odd.limit(0)).count() == 0
    listed = {r.doc_id: r for r in periods.runs(odd.where("doc_id between 12 and 17")).collect()}
    assert [tuple(x) for x in listed[12].runs] == [(0, 10, 2)] and listed[12].collapsed == "a b c"
    assert [tuple(x) for x in listed[14].runs] == [(2, 80000, 4)] and listed[14].collapsed == "very long abc def ghi jkl"
    assert [tuple(x) for x in listed[15].runs] == [(0, 16, 4)] and not listed[16].runs and listed[17].collapsed == "a"


def test_runs_of_random_words():
    """Small alphabets and nested repeats, several texts at once, so that grammars, boundaries and borders all matter."""
    rng = np.random.default_rng(3)

    def text():
        kinds = int(rng.integers(1, 5))
        out = list(rng.integers(0, kinds, rng.integers(0, 60)))
        for _ in range(rng.integers(0, 4)):
            block = list(rng.integers(0, kinds, rng.integers(1, 12))) * int(rng.integers(2, 8))
            out = out[: len(out) // 2] + block + out[len(out) // 2 :]
        return out * int(rng.integers(1, 3))

    for _ in range(300):
        texts = [text() for _ in range(rng.integers(1, 6))]
        size = [len(t) for t in texts]
        start, end, period = periods.find_runs(np.array(sum(texts, []), np.int64), np.repeat(np.arange(len(texts)), size))
        first = np.cumsum([0, *size])
        row = np.searchsorted(first, start, "right") - 1
        got = [(k, a - first[k], b - a, p) for k, a, b, p in zip(row, start, end, period, strict=True)]
        assert sorted(got) == sorted((k, *r) for k, t in enumerate(texts) for r in brute.word_runs(t))


def test_grammar_gives_the_words_back():
    """Every place of a rule holds the same words, and no pair is left twice without overlap."""
    rng = np.random.default_rng(4)
    symbol = np.array(list(rng.integers(0, 3, 300)) + [0, 1, 2, 1] * 50 + [1] * 100)
    stretch = np.repeat([0, 1], 300)
    lo, middle, hi, rule, begin = periods.grammar(symbol, stretch)
    for r in np.unique(rule):
        same = rule == r
        assert len({tuple(symbol[a:b]) for a, b in zip(lo[same], hi[same], strict=True)}) == 1
        assert len(set((middle - lo)[same])) == 1 and same.sum() > 1
    assert len(begin) < 250 and set(np.flatnonzero(np.diff(stretch)) + 1) <= set(begin)


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(periods, "range_hash", lambda data, start, end: np.zeros(len(start), np.uint64))
    c = textops.Chunk(0, 1, np.frombuffer(b"ab cd ab ef cd", np.uint8), np.array([0, 14]))
    got = periods.word_numbers(c, textops.words(c)).tolist()
    assert got[0] == got[2] and got[1] == got[4] and len(set(got)) == 3


def test_splice():
    c = textops.Chunk(0, 1, np.frombuffer(b" ".join(b"w%d" % i for i in range(50)), np.uint8), None)
    c.off = np.array([0, len(c.data)])
    import pyarrow as pa

    for i in (None, 7, 12, 29, *range(200, 260)):
        take = periods.splice(pa.array([i], pa.int64()), textops.words(c))
        assert [f"w{k}" for k in take] == brute.spliced(i, [f"w{k}" for k in range(50)])


def test_digest_of_no_runs():
    assert brute.runs(1, "")[-2:] == (hashlib.sha256(b"").hexdigest(),) * 2
