"""Tables kept by content, scratch tables by scope, and rows persisted by block."""

import os

import pytest
from pyspark.sql import functions as F

from echolot import scratch
from echolot.sources import cache


@pytest.fixture()
def source(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.range(10).selectExpr("id", "id * 2 AS x").write.parquet(path)
    return path


def test_cache(spark, tmp_path, source):
    base, calls = f"file://{tmp_path}/cache", []

    def make(rows, least, by="x"):
        calls.append(least)
        return rows.where(F.col(by) >= least)

    def get(least, rows=None, **more):
        rows = spark.read.parquet(source) if rows is None else rows
        return cache.cached(spark, base, "rows", {"rows": rows}, {"least": least} | more, make).count()

    assert [get(4), get(4), get(10), get(4)] == [8, 8, 5, 8] and calls == [4, 10]
    assert get(4, by="id") == 6 and len(calls) == 3
    # Other rows of the same files, and other files, are other tables.
    assert get(4, spark.read.parquet(source).where("id < 5")) == 3 and get(4, spark.read.parquet(source).where("id < 6")) == 4 and len(calls) == 5
    spark.range(100, 102).selectExpr("id", "id * 2 AS x").write.mode("append").parquet(source)
    assert get(4) == 10 and len(calls) == 6
    found = cache.manifests(spark, base, "rows")
    assert len(found) == 6 and sorted(m.rows for m in found) == [3, 4, 5, 6, 8, 10] and {m.name for m in found} == {"rows"}
    assert cache.forget(spark, base, "rows", found[0].key) == 1 and len(cache.manifests(spark, base, "rows")) == 5
    assert cache.forget(spark, base, "rows") == 5 and not os.listdir(f"{tmp_path}/cache/rows") and cache.forget(spark, base, "none") == 0


def test_an_interrupted_write_is_not_read(spark, tmp_path, source):
    base = f"file://{tmp_path}/cache"
    rows = {"rows": spark.read.parquet(source)}

    def fails(rows):
        return rows.select(F.raise_error(F.lit("lost")).cast("long").alias("id"))

    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            cache.cached(spark, base, "t", rows, {}, fails)
    assert not cache.manifests(spark, base, "t")
    assert cache.cached(spark, base, "t", rows, {}, lambda rows: rows).count() == 10
    # The folders of the failed runs go with the next clearing.
    cache.forget(spark, base, "t")
    assert not os.listdir(f"{tmp_path}/cache/t")


def test_two_runs_of_one_table(spark, tmp_path, source):
    """A run that ends second reads the table of the first and deletes its own."""
    base = f"file://{tmp_path}/cache"
    rows = {"rows": spark.read.parquet(source)}

    def slow(rows):
        assert cache.cached(spark, base, "t", {"rows": rows}, {}, lambda rows: rows.limit(3)).count() == 3
        return rows

    assert cache.cached(spark, base, "t", rows, {}, slow).count() == 3
    assert len(cache.manifests(spark, base, "t")) == 1 and len([x for x in os.listdir(f"{tmp_path}/cache/t") if "-" in x and not x.startswith(".")]) == 1


def test_scope(spark):
    outside = scratch.written(spark.range(3), "kept")
    with pytest.raises(ValueError, match="stop"), scratch.scope(spark):
        paths = [scratch.written(spark.range(5), "gone").inputFiles()[0].removeprefix("file://") for _ in range(3)]
        assert all(map(os.path.exists, paths))
        raise ValueError("stop")
    assert not any(map(os.path.exists, paths)) and outside.count() == 3


def test_a_query_leaves_nothing_in_its_scope(spark, sf):
    from echolot.catalogue import QUERIES

    before = list(scratch._made)
    with scratch.scope(spark):
        rows = QUERIES["continuation_duplicate_count"](spark, sf).collect()
        assert rows and len(scratch._made) > len(before)
    assert scratch._made == before


def test_persisted(spark):
    rows = spark.range(7)
    with scratch.persisted(rows) as held:
        assert held.count() == 7 and held.is_cached
    assert not rows.is_cached
