"""Words that a polynomial hash modulo 2**64 can't tell apart: the Thue-Morse words and their complements."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from echolot.llm import lexical, neardup, packing, quality, substring
from tests.llm import brute


def pair(bits):
    one, other = "a", "b"
    for _ in range(bits):
        one, other = one + other, other + one
    return one, other


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for bits in (10, 11, 13):
        x, y = pair(bits)
        base = 100 * bits
        rows += [(base, f"{x}\n{y}\n{x}"), (base + 1, f"{x} b c d"), (base + 2, f"{y} b c d")]
        fill = " ".join(f"w{bits}_{i}" for i in range(19))
        rows += [(base + 3, f"{x} {fill}"), (base + 4, f"{y} {fill}"), (base + 5, f"{y} {fill}")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicates(docs):
    rows, df = docs
    assert {tuple(r) for r in neardup.near_duplicates(df, k=4).collect()} == brute.components(rows)


def test_lines_and_words(docs):
    rows, df = docs
    assert {r.doc_id: tuple(r)[1:7] for r in quality.apply_rules(df).collect()} == {i: brute.quality(t) for i, t in rows}


def test_substrings(docs):
    from pyspark.sql import functions as F

    rows, df = docs
    got = substring.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert {tuple(r) for r in got.collect()} == brute.substring(rows)


def test_packing(docs):
    rows, df = docs
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = brute.packed(rows, Tokenizer.from_file(path))
    for r in packing.pack(df, path).collect():
        assert r.ids_crc32 == brute.crc(want[r.doc_id][r.start : r.start + r.length])


def test_search(spark, docs):
    rows, df = docs
    items = [(bits, pair(bits)[k]) for k, bits in enumerate((10, 11))]
    got = sorted((tuple(r) for r in lexical.search(df, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == brute.lexical(rows, items)
