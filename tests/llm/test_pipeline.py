"""The pipeline's stages, each against a plain version of what it does to its own input."""

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from echolot.llm import mixing
from echolot.llm.queries import domain_labels
from echolot.scratch import written
from tests.llm import brute


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, sf):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    made = [source]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made.append(written(stage(spark, made[-1], sf), name))
        assert made[-1].columns == source.columns
        assert [f.dataType for f in made[-1].schema] == [f.dataType for f in source.schema]
    docs, good, apart, cut, mixed = made
    kept = set(texts(good))
    for i, t in texts(docs):
        n, chars, symbols, dup, rep, base = brute.quality(t)
        if base or 10 * symbols > n or 10 * dup > 3 * len([x for x in t.split("\n") if brute.words(x)]):
            assert (i, t) not in kept
    groups = brute.components(texts(good), k=5)
    assert [i for i, _ in texts(apart)] == sorted(i for i, _, _, first in groups if first)
    rows = [(i, t.encode()) for i, t in texts(apart)]
    want = [(i, bytes(x for x, m in zip(b, mask, strict=True) if not m).decode("utf-8", "ignore")) for (i, b), mask in zip(rows, brute.removed(rows, 100), strict=True)]
    assert texts(cut) == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    rates = {r.doc_id: r.copies for r in mixing.document_rates(cut, domain_labels(spark, sf)).collect()}
    assert Counter(i for i, _ in texts(mixed)) == Counter({i: n for i, n in rates.items() if n})
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = brute.packed(texts(mixed), t)
    pieces = corpus_pipeline.STAGES[-1][1](spark, mixed, sf).collect()
    assert sum(r.length for r in pieces) == sum(len(ids[i]) for i, _ in texts(mixed))
    assert all(r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length]) for r in pieces)


def test_rates_match_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(10, 500, 400)
    table = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    targets = {"clean": 0.7, "low": 0.2, "toxic": 0.1}
    r = mixing.rates(n, p, mixing.fit_rates(table, targets))
    assert (r >= 0).all()
    total = (n * r) @ p
    assert np.allclose(total / n.sum(), [0.7, 0.2, 0.1], atol=2e-3)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), domain_labels(spark, sf)
    model = mixing.fit_classifier(docs, labels.where("doc_id % 3 != 0"))
    held = labels.where("doc_id % 3 = 0").join(mixing.with_posteriors(docs, model), "doc_id").collect()
    right = np.mean([int(np.argmax(r.p)) == r.domain for r in held])
    assert right > 0.85
    empty = mixing.document_rates(docs.limit(0), labels)
    assert empty.count() == 0
    odd = spark.createDataFrame([(None, None, 0), (1, "", 0), (1, "a b", 0)], "doc_id long, text string, p int")
    assert mixing.document_rates(odd, labels.limit(0)).count() == 3


def test_scarce_domain_reaches_its_target(spark):
    p = np.array([[0.98, 0.01, 0.01]] * 400 + [[0.01, 0.98, 0.01]] + [[0.01, 0.01, 0.98]] * 8)
    rows = [(100, [float(x) for x in b]) for b in p]
    table = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    assert mixing.TARGETS == {"clean": 0.9, "low": 0.08, "toxic": 0.02}
    r = mixing.rates(np.full(len(p), 100), p, mixing.fit_rates(table))
    assert r.max() > 4
    rated = spark.createDataFrame([(*a, float(x)) for a, x in zip(rows, r, strict=True)], "n_tokens long, p array<double>, rate double")
    for domain, target, reached in mixing.domain_totals(rated).collect():
        assert abs(target - mixing.TARGETS[domain]) < 1e-9
        assert abs(reached - target) < 2e-3


def rate_table(spark, n, p):
    return spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")


@pytest.mark.parametrize("seed, targets", [(2, (0.05, 0.05, 0.9)), (3, (0.98, 0.01, 0.01))])
def test_rates_against_plain_least_squares(spark, seed, targets):
    """Small steps of projected gradient descent, run for long, reach no smaller squared distance."""
    rng = np.random.default_rng(seed)
    p, n = rng.dirichlet([0.2, 0.2, 0.2], 60), rng.integers(1, 300, 60)
    weight = dict(zip(mixing.DOMAINS, targets, strict=True))
    goal, a = np.array(targets) * n.sum(), p * n[:, None]
    r = np.ones(60)
    pace = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20000):
        r = np.maximum(0, r - pace * (a @ (a.T @ r - goal)))
    got = mixing.rates(n, p, mixing.fit_rates(rate_table(spark, n, p), weight))
    assert (got >= 0).all()
    miss = lambda r: np.abs(a.T @ r - goal).max() / n.sum()
    assert miss(got) <= miss(r) + 2e-3


def test_targets_out_of_reach_are_told(spark):
    p = np.array([[0.7, 0.3, 0.0]] * 20)
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.fit_rates(rate_table(spark, np.full(20, 50), p))


def test_repeated_ids_and_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e"), (None, "f"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 2), (1, 0), (None, 1), (9, 1)], "doc_id long, domain int")
    got = mixing.document_rates(docs, labels).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 2), ("1", 3), ("2", 0), ("None", 1)]
    assert len({round(r.rate, 9) for r in got}) >= 1 and all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in got)


def test_stages_on_odd_rows(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    text = " ".join(f"word{i}" for i in range(60))
    odd = [(None, text, None, None, None), (None, None, "en", "s", 0), (1, "", "en", "s", 0), (1, text + " more", "en", "s", 1), (1, text + " more", "en", "s", 1), (2, "x " * 30000, None, "s", 2)]
    docs = spark.createDataFrame(odd, schema)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name != "pack_windows":
            assert made.columns == docs.columns
        made.collect()


def test_copies_of_a_long_text(spark):
    """A text of 700 kB at a rate of thousands leaves in batches of bounded bytes, with none lost."""
    import pyarrow as pa

    size = np.array([10, 700_000, 5])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["x" * n for n in size])], names=["doc_id", "text"])
    count, most = {1: 0, 2: 0, 3: 0}, 0
    for part in mixing.repeated_rows(batch, np.array([2, 4000, 3]), size):
        most = max(most, part.nbytes)
        for i, n in Counter(part.column(0).to_pylist()).items():
            count[i] += n
    assert count == {1: 2, 2: 4000, 3: 3} and most < 20 << 20


def test_rows_draw_their_own_copies(spark):
    """Rows without an id, equal or not, round apart: of 2000 rows of rate 0.5 about half stay."""
    import pyarrow as pa

    from echolot.llm.textops import chunks

    (c,) = chunks(pa.array(["same"] * 1000 + [f"text {i}" for i in range(1000)]))
    draw = mixing.draws(pa.array([None] * 2000, pa.int64()), c)
    kept = mixing.copies(np.full(2000, 0.5), draw)
    assert 430 < kept[:1000].sum() < 570 and 430 < kept[1000:].sum() < 570


def test_rates_replay_projected_steps():
    p, path = np.array([[1.0, 0.0], [0.5, 0.5]]), [np.array([2.0, 0.0]), np.array([-1.0, 0.0])]
    # The first rate is cut to zero before it grows again; steps that merely add up would give 0.
    assert mixing.rates(np.array([1, 1]), p, path).tolist() == [1.0, 0.5]
    # Steps are gradients over rates: they grow with a document's tokens, and leave one without tokens alone.
    assert mixing.rates(np.array([0, 2]), p, path[1:]).tolist() == [1.0, 2.0]
