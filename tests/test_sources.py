"""Round trips of the readers and writers, and the stream forms."""

import json

import pytest
from pyspark.sql import functions as F

from echolot.plans.filters import FeatureSet, run, with_score
from echolot.sources import tables
from echolot.sources.token_corpus import FilteredTokenReader, TokenCorpus, TokenReader, TokenWriter, read_records, write_corpus
from echolot.streaming import metrics


def test_token_corpus(spark, tmp_path):
    rows = [list(range(i, i + 5 + i % 3)) for i in range(100)]
    write_corpus(f"{tmp_path}/c", rows)
    spark.dataSource.register(TokenCorpus)
    read = lambda **o: {r.sequence_id: r.tokens for r in spark.read.format("token_corpus").options(**o).load(f"{tmp_path}/c").collect()}
    assert read(rows_a_partition=7) == dict(enumerate(rows))
    assert read(start=10, end=12) == {10: rows[10], 11: rows[11]}
    assert read(start=3, end=4, offset=1, length=2) == {3: rows[3][1:3]}
    with open(f"{tmp_path}/c.idx", "r+b") as f:
        f.write(b"X")
    with pytest.raises(Exception, match="not a token index"):
        read()


def test_corpus_filters(spark, tmp_path):
    """Bounds on the id narrow what is read: the reader's own ranges say so."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

    rows = [[i] * 4 for i in range(100)]
    write_corpus(f"{tmp_path}/c", rows)
    reader = lambda: FilteredTokenReader(f"{tmp_path}/c", 0, None, 10, 0, None)
    for filters, left, span in (
        ([GreaterThan(("sequence_id",), 90), IsNotNull(("sequence_id",))], 1, (91, 100)),
        ([GreaterThan(("sequence_id",), 20), LessThanOrEqual(("sequence_id",), 33)], 0, (21, 34)),
        ([EqualTo(("sequence_id",), 7)], 0, (7, 8)),
        ([In(("sequence_id",), (5, 9))], 1, (5, 10)),
        ([EqualTo(("tokens",), 1)], 1, (0, 100)),
    ):
        r = reader()
        assert len(list(r.pushFilters(filters))) == left
        parts = r.partitions()
        assert (parts[0].start, parts[-1].end) == span and sum(p.end - p.start for p in parts) == span[1] - span[0]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenCorpus)
    df = spark.read.format("token_corpus").option("push_filters", True).load(f"{tmp_path}/c")
    assert sorted(r.sequence_id for r in df.where("sequence_id in (3, 8) or sequence_id = 50").collect()) == [3, 8, 50]
    assert [r.tokens for r in df.where("sequence_id >= 98").collect()] == [[98] * 4, [99] * 4]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(ValueError, match="negative"):
        TokenReader(f"{tmp_path}/c", 0, None, 10, -1, None)


def test_corpus_written_by_tasks(spark, tmp_path):
    spark.dataSource.register(TokenCorpus)
    rows = [[(i * 7 + k) % 60000 for k in range(i % 9)] for i in range(500)]
    df = spark.createDataFrame([(x, t) for x, t in zip("ab" * 250, rows, strict=True)], "note string, tokens array<int>").coalesce(5)
    path = f"{tmp_path}/w"
    df.write.format("token_corpus").mode("append").option("shard_bytes", 100).save(path)
    read = lambda: [r.tokens for r in spark.read.format("token_corpus").option("rows_a_partition", 33).load(path).orderBy("sequence_id").collect()]
    assert read() == rows
    df.limit(3).write.format("token_corpus").mode("append").save(path)
    assert read() == rows + rows[:3]
    # A task that fails leaves no listed shard: what was there before stays as it is.
    listed = (tmp_path / "w/_shards.json").read_text()
    with pytest.raises(Exception, match="doesn't fit"):
        spark.createDataFrame([([1, 2],), ([70000],)], "tokens array<int>").repartition(2).write.format("token_corpus").mode("append").save(path)
    assert (tmp_path / "w/_shards.json").read_text() == listed and read() == rows + rows[:3]
    df.limit(2).write.format("token_corpus").mode("overwrite").save(path)
    assert read() == rows[:2]
    with pytest.raises(Exception, match="is not a token corpus"):
        spark.read.format("token_corpus").load(str(tmp_path)).count()


def test_a_retried_task_is_listed_once(tmp_path):
    """Two attempts of one task write shards of their own, and the commit lists those of the one that counts."""
    import pyarrow as pa
    from pyspark import TaskContext

    class Context:
        def partitionId(self):
            return 3

    writer = TokenWriter(str(tmp_path), 0, 8, False, 1 << 20)
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 2], [], [3]], pa.list_(pa.int32()))], names=["tokens"])
    get, TaskContext.get = TaskContext.get, staticmethod(lambda: Context())
    try:
        first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    finally:
        TaskContext.get = get
    writer.commit([None, second])
    reader = TokenReader(str(tmp_path), 0, None, 10, 0, None)
    got = [t for part in reader.partitions() for b in reader.read(part) for t in b.column(1).to_pylist()]
    assert got == [[1, 2], [], [3]] and first.names != second.names
    writer.abort([first])
    assert len(list(tmp_path.iterdir())) == 3


def test_records_through_a_path_that_only_spark_opens(spark, tmp_path):
    import numpy as np

    rows = np.random.default_rng(1).integers(0, 65536, (300, 17)).astype("<u2")
    (tmp_path / "raw.bin").write_bytes(rows.tobytes())
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./in", f"file://{tmp_path}")
    got = {r.sequence_id: r.tokens for r in read_records(spark, "viewfs://shelf/in/raw.bin", 17).collect()}
    assert got == {i: x.tolist() for i, x in enumerate(rows)}
    with pytest.raises(ValueError, match="can't be read"):
        read_records(spark, "viewfs://shelf/in/raw.bin", 0)


def test_hash_files(spark, tmp_path):
    hashes = spark.createDataFrame([(1, 0, 99), (1, 1, -5), (2, 0, 99)], "sequence_id long, offset int, gram_hash long")
    tables.write_hashes_csv(hashes, f"{tmp_path}/h")
    assert sorted(map(tuple, tables.read_hashes_csv(spark, f"{tmp_path}/h").collect())) == sorted(map(tuple, hashes.collect()))
    many = hashes.union(spark.range(10, 15).selectExpr("id", "0", "99"))
    tables.positions_text(many, f"{tmp_path}/p", most=3)
    lines = sorted(r[0] for r in spark.read.text(f"{tmp_path}/p").collect())
    assert lines == sorted(["-5 1:1", "99 1:0 2:0 10:0", "99 11:0 12:0 13:0", "99 14:0"])


def test_tables(spark, tmp_path):
    p = str(tmp_path)
    t = spark.createDataFrame([(1, 2, "x")], "sequence_id int, frequency int, more string")
    tables.write_table(t, f"{p}/t", files=1)
    assert tables.read_table(spark, f"{p}/t", "sequence_frequencies").dtypes == [("sequence_id", "bigint"), ("frequency", "bigint")]
    with pytest.raises(ValueError, match="lacks"):
        tables.read_table(spark, f"{p}/t", "code_scores")
    assert tables.split_name("deduped.1.4b") == "deduped_1.4b"
    (tmp_path / "log.csv").write_text("index,loss\n1,0.5\nindex,loss\n2,0.25\n")
    assert [tuple(r) for r in tables.read_appended_log(spark, f"{p}/log.csv", "index long, loss double").orderBy("index").collect()] == [(1, 0.5), (2, 0.25)]
    (tmp_path / "eval.tsv").write_text("title\nlabel\tindex\ttext\n1\t7\tcode\n\t8\tnone\n")
    assert [tuple(r) for r in tables.read_labelled_tsv(spark, f"{p}/eval.tsv").orderBy("index").collect()] == [(1, 7, "code"), (None, 8, "none")]
    (tmp_path / "f.json").write_text(json.dumps({"memorized": [0, 3], "non_memorized": [5, 0]}))
    got = tables.token_frequencies_json(spark, f"{p}/f.json")
    assert [tuple(r) for r in got.orderBy("token_id").collect()] == [(0, 0, 5), (1, 3, 0)]
    tables.write_token_frequencies_json(got, f"{p}/g", slots=3)
    assert [tuple(r) for r in tables.token_frequencies_json(spark, f"{p}/g").orderBy("token_id").collect()] == [(0, 0, 5), (1, 3, 0), (2, 0, 0)]
    (tmp_path / "ids.txt").write_text("5\n3\n\n")
    assert sorted(r[0] for r in tables.read_ids(spark, f"{p}/ids.txt").collect()) == [3, 5]
    d = tmp_path / "exp/length-0.25/dup-0.5"
    d.mkdir(parents=True)
    (d / "metrics.json").write_text('{"auc": 0.5}')
    assert [tuple(r) for r in tables.experiment_metrics(spark, f"{p}/exp/*/*/*.json").collect()] == [("length", 0.25, "dup", 0.5, "auc", 0.5)]
    bands = [tables.slice_by_percent(spark.range(100), "id", a, a + 10).count() for a in range(0, 100, 10)]
    assert sum(bands) == 100


def test_pipeline_without_features_has_null_columns(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6])], "sequence_id long, tokens array<int>")
    out = with_score(run(rows, FeatureSet()))
    r = out.first()
    assert r.sequence_duplicates is None and r["0_8_snowclones"] is None and r.is_incrementing and r.memorization_score == 1.0
    wide = spark.createDataFrame([(1, 1.0, 0.5)], "sequence_id long, `1.4b` double, 70m double")
    assert {(x.model, x.memorization_score) for x in with_score(rows, wide, ["1.4b", "70m"]).collect()} == {("1.4b", 1.0), ("70m", 0.5)}


def test_streams(spark, sf, tmp_path):
    rows = spark.createDataFrame([(i, [i, i + 1, i]) for i in range(10)], "sequence_id long, tokens array<int>")
    rows.write.parquet(f"{tmp_path}/in")
    features = FeatureSet(sequence_frequencies=spark.createDataFrame([(1, 9)], "sequence_id long, frequency long"))
    stream = metrics.stream_metrics(metrics.sequence_stream(spark, f"{tmp_path}/in"), features, {1: 2}, {1: 3})
    metrics.write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 10 and out.where("sequence_duplicates = 9 and max_frequency = 5").count() == 1
    batch = metrics.event_counts(spark.read.parquet(f"{sf}/events.parquet"))
    assert batch.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
