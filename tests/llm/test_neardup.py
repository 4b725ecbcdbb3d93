"""Near duplicates against all pairs on small tables."""

import random

import pytest

from echolot.llm import neardup
from echolot.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_rows import ODD, docs


def test_query(spark, sf):
    assert {tuple(r) for r in QUERIES["op1_near_duplicates"](spark, sf).collect()} == brute.components(docs(spark, sf))


def test_chains_and_copies(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, i = [], 0
    for _ in range(6):
        text = [word() for _ in range(120)]
        for _ in range(25):  # each a small step from the last, so the ends are far apart
            text = list(text)
            text[rng.randrange(120)] = word()
            rows.append((i, " ".join(text)))
            i += 1
    rows += [(i + k, rows[3][1]) for k in range(40)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, component long")
    assert {tuple(r) for r in neardup.near_duplicates(table, k=4).collect()} == brute.components(rows)


def test_odd_rows(spark):
    rows = list(enumerate(ODD)) + [(100 + i, t) for i, t in enumerate(ODD)]
    table = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, node long")
    assert {tuple(r) for r in neardup.near_duplicates(table, k=4).collect()} == brute.components(rows)
    assert neardup.near_duplicates(table.limit(0)).count() == 0
    more = spark.createDataFrame([(1, "a b c d e"), (1, "f g h i j"), (2, "f g h i j"), (3, "a b c d e"), (None, "a b c d e"), (None, None), (4, None), (5, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in neardup.near_duplicates(more).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, None), (None, None), (4, 4), (5, 5)], key=str)
    assert sorted((r.doc_id for r in neardup.deduplicate(more).collect()), key=str) == sorted([1, 1, 4, 5, None, None], key=str)


def test_pairs_inside_a_crowd(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    core = [word() for _ in range(120)]
    rows = [(i, " ".join(core + [word() for _ in range(20)])) for i in range(300)]  # 0.75 similar, by the core alone
    for i in range(100, 120):
        own = [word() for _ in range(7)]
        rows[2 * i - 80] = (2 * i - 80, " ".join(core + own + [word() for _ in range(12)]))
        rows[2 * i - 79] = (2 * i - 79, " ".join(core + own + [word() for _ in range(12)]))
    want = brute.components(rows)
    assert sum(not kept for *_, kept in want) == 20
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in neardup.near_duplicates(table, k=4).collect()} == want


def templated(rng, template, own, shared, pairs=150):
    """Pairs of texts on one template: strangers have the template alone in common, mates also ``shared`` words."""
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    core, rows = [word() for _ in range(template)], []
    for _ in range(pairs):
        mine = [word() for _ in range(shared)]
        rows += [" ".join(core + mine + [word() for _ in range(own)]) for _ in range(2)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("template, own, shared", [(140, 14, 6), (140, 13, 10)])
def test_no_link_is_lost_on_a_template(spark, template, own, shared):
    rows = templated(random.Random(11), template, own, shared)
    want = brute.components(rows)
    assert sum(not kept for *_, kept in want) == 150
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in neardup.near_duplicates(table, k=4).collect()} == want


def test_variants_of_one_text(spark):
    """Every variant is linked with the text in the middle, and hardly with one another."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    base = [word() for _ in range(200)]
    rows = [" ".join(base)]
    for _ in range(60):
        text = list(base)
        for at in rng.sample(range(200), 5):
            text[at] = word()
        rows.append(" ".join(text[: rng.randint(196, 200)]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in neardup.near_duplicates(table, k=4).collect()} == brute.components(rows)


@pytest.mark.parametrize("stragglers, crowd", [(0, 0), (0, 1000)])
def test_crowds_of_many_sizes(spark, monkeypatch, stragglers, crowd):
    """Cut and changed versions of a few texts, so that sizes and similarities lie on both sides of every bound."""
    monkeypatch.setattr(neardup, "STRAGGLERS", stragglers)
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "BLOCK_OTHERS", 40)
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(60)]
        for _ in range(50):
            text = base[: rng.randint(45, 60)] + [word() for _ in range(rng.randint(0, 6))]
            for at in rng.sample(range(45), rng.randint(0, 2)):
                text[at] = word()
            rows.append(" ".join(text))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in neardup.near_duplicates(table, k=4).collect()} == brute.components(rows)


def test_keys_outside_an_origin(spark):
    """Two similar members of a star meet in what they have outside its origin, or both fit inside it."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(60):
        text = base[: rng.randint(55, 80)] + [word() for _ in range(rng.randint(0, 8))]
        text[rng.randrange(50)] = word()
        texts.append(" ".join(text))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [brute.shingles(t) for t in texts]
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    kinds = set()
    for origin in (0, 7, 33):
        stars = spark.createDataFrame([(origin, i, min(map(len, sets))) for i in range(len(sets)) if i != origin], "a long, b long, least long")
        got = {r.b: r for r in neardup.outside(stars, table, 4, 80).collect()}
        assert all(r.linked == linked(origin, i) for i, r in got.items())
        for i in got:
            for j in got:
                if i < j and linked(i, j):
                    both_inside = len(sets[i]) <= got[j].inside and len(sets[j]) <= got[i].inside
                    assert both_inside or set(got[i]["keys"]) & set(got[j]["keys"])
                    kinds.add(both_inside)
    assert kinds == {True, False}


def test_strangers_in_a_groups_bucket_cost_no_texts(spark, monkeypatch):
    """Texts that share half of a large group's words meet its buckets, but numbers alone rule their pairs out."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    base = [word() for _ in range(120)]
    texts = [" ".join(base[:120] + [word()]) for _ in range(150)] + [" ".join(base[:84] + [word() for _ in range(37)]) for _ in range(20)]
    rows, compared, plain = list(enumerate(texts)), [], neardup.compared_pairs
    monkeypatch.setattr(neardup, "compared_pairs", lambda pairs, *more: (compared.append(pairs.count()), plain(pairs, *more))[1])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in neardup.near_duplicates(table, k=4).collect()} == brute.components(rows)
    assert sum(compared[1:]) < 20 * 19  # of 20 strangers with 150 members and with one another


@pytest.mark.parametrize("edges", [1 << 17, 8])
def test_components_of_chains(spark, monkeypatch, edges):
    """Tasks shrink their edges first, so that few tables are written; with few edges at once the rounds do the rest."""
    monkeypatch.setattr(neardup, "EDGES", edges)
    made, kept = [], neardup._kept
    monkeypatch.setattr(neardup, "_kept", lambda df: (made.append(1), kept(df))[1])
    rows = [(100 * c + i, 100 * c + i + 1) for c in range(3) for i in range(40)]
    random.Random(16).shuffle(rows)
    got = {tuple(r) for r in neardup.components(spark.createDataFrame([*rows, (7, 7), (7, 8)], "u long, v long")).collect()}
    assert got == {(100 * c + i, 100 * c) for c in range(3) for i in range(1, 41)}
    assert edges == 8 or len(made) <= 3
    assert neardup.components(spark.createDataFrame([], "u long, v long")).count() == 0
