"""Running sums, successors, ranks and quantiles of groups that span many partitions, against plain versions."""

import math
import random
from itertools import pairwise

import numpy as np
import pytest

from echolot.operators import metrics, ordering, sampling, stats


@pytest.fixture(scope="module")
def rows(spark):
    """A group of a third of all rows, a null group, ties, nulls and a constant group."""
    rng = random.Random(11)
    data = []
    for i in range(3000):
        g = "big" if i % 3 == 0 else None if i % 50 == 1 else f"g{i % 40}"
        data.append((i, g, None if rng.random() < 0.05 else float(rng.randrange(-40, 60)) / 8, rng.gauss(0, 1) if g != "g7" else 2.0, rng.randrange(2)))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that few rows span partitions
    yield data, spark.createDataFrame(data, "id long, g string, x double, y double, label int")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def groups(data):
    out = {}
    for r in data:
        out.setdefault(r[1], []).append(r)
    return out


def test_sums_and_successors(rows):
    data, df = rows
    dealt = ordering.dealt(df, ["g"], ["y", "id"])
    assert dealt.where("g = 'big'").select("__part").distinct().count() > 1
    before = {r.id: r.s for r in ordering.sums_before(dealt, ["g"], ["y", "id"], {"s": "label"}).collect()}
    after = {r.id: r.n for r in ordering.next_values(dealt, ["g"], ["y", "id"], {"n": "id"}).collect()}
    for members in groups(data).values():
        order = sorted(members, key=lambda r: (r[3], r[0]))
        total = 0
        for r, nxt in zip(order, [*order[1:], None], strict=True):
            assert before[r[0]] == total and after[r[0]] == (nxt and nxt[0])
            total += r[4]


@pytest.mark.parametrize("small", [0, 100, 1 << 16])
def test_quantiles(rows, small):
    data, df = rows
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.column, r.share): r.value for r in ordering.quantiles(df, ["x", "y"], shares, "g", small=small).collect()}
    for g, members in groups(data).items():
        for c, k in (("x", 2), ("y", 3)):
            want = np.quantile([r[k] for r in members if r[k] is not None], shares)
            assert np.allclose([got[g, c, q] for q in shares], want, rtol=0, atol=1e-12)
    whole = ordering.quantile_columns(df, {"a": ("x", 0.5), "b": ("y", 0.1)}, small=small).collect()
    assert len(whole) == 1 and math.isclose(whole[0].b, np.quantile([r[3] for r in data], 0.1))


def test_quantiles_of_odd_values(spark):
    values = [float("-inf"), -1e308, -1.0, -0.0, 0.0, 5e-324, 1.0, 1e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r.share: r.value for r in ordering.quantiles(df, ["v"], [k / 8 for k in (1, 2, 3, 4, 5, 6, 7)], small=0).collect()}
    assert [got[k / 8] for k in range(1, 8)] == values[1:-1]
    assert ordering.quantiles(df.where("v is null"), ["v"], [0.5], small=0).collect()[0].value is None
    assert ordering.quantiles(df.limit(0), ["v"], [0.5]).count() == 0
    assert (np.diff(ordering.ordered_bits(np.array(values)).astype(object)) >= 0).all()
    assert ordering.from_bits(ordering.ordered_bits(np.array(values))).tolist() == values


def test_mid_ranks(rows):
    data, df = rows
    got = {(r.g, r.value): (r.rank, r.n) for r in stats.mid_ranks(df, "x", "g").collect()}
    for g, members in groups(data).items():
        xs = sorted(r[2] for r in members if r[2] is not None)
        for v in set(xs):
            places = [i + 1 for i, x in enumerate(xs) if x == v]
            assert got[g, v] == (sum(places) / len(places), len(places))


def test_curves(rows):
    data, df = rows
    auc = {r.g: r.roc_auc for r in metrics.roc_auc(df, "label", "y", "g").collect()}
    ap = {r.g: r.average_precision for r in metrics.average_precision(df, "label", "y", "g").collect()}
    area = {r.g: r.pr_auc for r in metrics.area_under_precision_recall(df, "label", "y", "g").collect()}
    for g, members in groups(data).items():
        pos, neg = [r[3] for r in members if r[4]], [r[3] for r in members if not r[4]]
        won = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        assert math.isclose(auc[g], won / (len(pos) * len(neg)))
        points = [(0.0, 1.0)]
        for t in sorted({r[3] for r in members}, reverse=True):
            tp, fp = sum(x >= t for x in pos), sum(x >= t for x in neg)
            points.append((tp / len(pos), tp / (tp + fp)))
        assert math.isclose(ap[g], sum((b[0] - a[0]) * b[1] for a, b in pairwise(points)))
        assert math.isclose(area[g], sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pairwise(points)))


def test_xi(rows):
    data, df = rows
    got = {r.g: (r.statistic, r.n) for r in stats.xi(df, "x", "y", "id", "g").collect()}
    for g, members in groups(data).items():
        m = sorted((r[2], r[0], r[3]) for r in members if r[2] is not None)
        ys = [y for _, _, y in m]
        rank = [sum(b <= a for b in ys) for a in ys]
        up = [sum(b >= a for b in ys) for a in ys]
        bottom = 2 * sum(x * (len(m) - x) for x in up)
        if bottom:
            assert math.isclose(got[g][0], 1 - len(m) * sum(abs(a - b) for a, b in pairwise(rank)) / bottom, abs_tol=1e-12) and got[g][1] == len(m)


def test_splits(rows):
    data, df = rows
    split = {r.id: r.split for r in sampling.stratified_split(df, "g", "id", [0.5, 0.75]).collect()}
    assert len(split) == len(data)
    for members in groups(data).values():
        n = len(members)
        count = [sum(split[r[0]] == k for r in members) for k in range(3)]
        assert count[0] == math.ceil(n / 2) and sum(count) == n and abs(count[1] - n / 4) <= 1
    even = sampling.balance_groups(df, "g", "id").groupBy("g").count().collect()
    assert {r["count"] for r in even} == {min(len(m) for m in groups(data).values())}
