"""Operators that work row by row or on small groups, against plain versions and on odd rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echolot.llm import chat, packing, quality, warc
from echolot.llm.queries import QUERIES
from tests.llm import brute

ODD = [
    None, "", " ", "\n\n", "a", "word " * 30, "x\n" * 50, "it's we'll don''t 'tis", "日本語 テスト 123 😀😀 <|endoftext|>", "</s>[INST] ok [/INST]",
    "\\<[\\\\<<[[", "A b C d e f g h\nA b C d e f g h\n\nA b C d e f g h", "long " + "ab cd " * 60000, "tab\tvt\x0bff\x0ccr\r\nx", "a" * 300,
]
ODD_DOCS = [(i, t) for i, t in enumerate(ODD)] + [(3, "\n\n"), (None, "no id here at all"), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ODD_DOCS], "doc_id long, text string, t string, i int")


def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_quality(spark, sf):
    got = {r.doc_id: tuple(r)[1:7] for r in QUERIES["op2_quality_cascade"](spark, sf).collect()}
    assert got == {i: brute.quality(t) for i, t in docs(spark, sf)}


def test_quality_odd_rows(spark, odd):
    got = sorted((tuple(r)[:7] for r in quality.apply_rules(odd).collect()), key=str)
    assert got == sorted(((i, *brute.quality(t)) for i, t in ODD_DOCS), key=str)
    assert quality.apply_rules(odd.limit(0)).count() == 0
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema


def test_quality_order_does_not_change_the_verdict(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    one = quality.apply_rules(rows, rules=list(quality.RULES)).select("doc_id", "kept")
    two = quality.apply_rules(rows, rules=list(quality.RULES)[::-1]).select("doc_id", "kept")
    assert one.exceptAll(two).count() == 0
    assert sorted(r.name for r in quality.plan_cascade(rows)) == sorted(r.name for r in quality.RULES)


def check_pieces(rows, want):
    """Pieces are gapless in documents and in windows, and hold the ids."""
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[i])
            assert r.ids_crc32 == brute.crc(want[i][at : at + r.length])
            at += r.length
        assert at == len(want[i])
    short = 0
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        short += at < 1024
    assert short <= 1


def test_packing(spark, sf, odd):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    check_pieces(QUERIES["op9_pack_windows"](spark, sf).collect(), brute.packed(docs(spark, sf), t))
    distinct = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(packing.pack(distinct, public_tokenizers.path("byte_bpe_50k.json")).collect(), brute.packed([(r.doc_id, r.text) for r in distinct.collect()], t))
    assert packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json")).where("start = 0").count() == len(ODD_DOCS)
    assert packing.pack(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_sequences(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.sequences(packing.pack(rows, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)).collect()
    assert all(len(r.input_ids) == 1024 or r.n_tokens & (r.n_tokens - 1) == 0 for r in got)
    assert all(r.boundaries[0].offset == 0 for r in got)


def test_warc(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert {tuple(r) for r in QUERIES["op6_warc_captures"](spark, sf).collect()} == brute.warc(pages)


def test_warc_odd_rows(spark, tmp_path):
    rows = [(1, "http://a/x", "<p>one</p>"), (2, None, None), (3, "bad url\r\nX: y", "<p>one</p>"), (4, "http://b", ""), (5, "http://c", "é\r\n\r\nWARC/1.1\r\n"), (6, "", "é\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    assert {tuple(r) for r in warc.page_digests(spark, pages).collect()} == brute.warc([(i, h) for i, _, h in rows])
    assert warc.page_digests(spark, pages.limit(0)).count() == 0
    again = warc.page_digests(spark, pages.union(pages.limit(1)))
    assert sorted(tuple(r) for r in again.collect() if r.page_id == 1) == [(1, 10, brute.sha1(b"<p>one</p>"), "response", None), (1, 10, brute.sha1(b"<p>one</p>"), "revisit", 1)]
    assert again.count() == len(rows) + 1
    assert warc.page_digests(spark, spark.createDataFrame([(None, None, "x"), (2, "u", "x")], pages.drop("digest").schema)).where("page_id is null and refers_to = 2").count() == 1
    warc.write_archives(pages, f"file://{tmp_path}/a")
    nested = warc.assemble(warc.read_records(spark, f"file://{tmp_path}/a")).collect()
    assert len(nested) == 6 and all(r.request.kind == "request" and r.metadata.payload.startswith(b"page-id: ") for r in nested)
    all_responses = warc.page_digests(spark, pages, min_payload=1000)
    assert {r.record_type for r in all_responses.collect()} == {"response"}


def test_warc_on_shuffled_input(spark):
    """Each payload has one response, that of the smallest id, however the rows come; with repeated ids too."""
    pages = spark.range(4000).selectExpr("id AS page_id", "'u' AS url", "concat('payload ', id % 50) AS html").repartition(16)
    want = brute.warc([(i, f"payload {i % 50}") for i in range(4000)])
    assert {tuple(r) for r in warc.page_digests(spark, pages).collect()} == want
    twice = warc.page_digests(spark, pages.union(pages).repartition(7)).collect()
    assert len(twice) == 8000 and sum(r.record_type == "response" for r in twice) == 50
    assert all((r.refers_to is None) == (r.record_type == "response") and (r.refers_to is None or r.refers_to == r.page_id % 50) for r in twice)


def test_chat(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {tuple(r)[:5] for r in QUERIES["op8_chat_format"](spark, sf).collect()} == brute.chat(turns)


def test_chat_odd_rows(spark):
    turns = [(k % 3, k, ("user", "assistant", "sys<|em|>")[k % 3], t) for k, t in enumerate(ODD)]
    rows = spark.createDataFrame([(*r, 0) for r in turns], "conv_id long, turn long, role string, text string, formatted int")
    made = chat.format_turns(rows)
    assert {tuple(r)[:5] for r in chat.read_back(made).collect()} == brute.chat(turns)
    body = F.col("formatted")
    assert made.where(body.contains("[INST]") | body.contains("</s>")).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None), (None, 1, "assistant", "x"), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.read_back(chat.format_turns(nulls)).collect()}
    assert got == {None: 2, 7: 3}
    assert chat.read_back(chat.format_turns(nulls.limit(0))).count() == 0
