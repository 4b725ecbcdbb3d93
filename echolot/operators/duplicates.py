"""Exact duplicate counting by n-grams.

Windows are made in Arrow, all of a batch at once.  Where only some grams are asked for, their keys become a filter that is tested in the
scan (membership.py), so that the shuffle gets the wanted windows and about 1 % of the others.  Keys and hashes only bring windows
together: what is counted as equal has equal tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows
from ..functions.sequences import ngrams
from ..scratch import written
from . import membership

Keys = Callable[[np.ndarray, int], np.ndarray]


def gram_table(sequences: DataFrame, n: int, drop_last: bool = False) -> DataFrame:
    """sequence_id, offset, gram: every window of n tokens."""
    return sequences.select("sequence_id", F.explode(ngrams(F.col("tokens"), n, drop_last)).alias("g")).select("sequence_id", "g.offset", "g.gram")


def gram_totals(sequences: DataFrame, n: int, drop_last: bool = False) -> DataFrame:
    """sequence_id, n and n_distinct: how many windows of n tokens a sequence has, and how many different ones; ids without windows have no row.

    A sequence's windows are counted in the scan.  Only where several rows have an id their windows are moved, to be compared across rows.
    """
    _check(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in windows.parts(batch.column(1), n, drop_last):
                size = part.rows.stop - part.rows.start
                total = np.bincount(part.row, minlength=size)
                distinct = np.bincount(part.row[windows.first_of_row(part, n)], minlength=size)
                some = np.flatnonzero(total)
                ids = batch.column(0).slice(part.rows.start, size).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(total[some]), pa.array(distinct[some])], names=["sequence_id", "n", "n_distinct"])

    rows = sequences.select(F.col("sequence_id").cast("long").alias("sequence_id"), F.col("tokens").cast("array<int>").alias("tokens"))
    each = rows.mapInArrow(run, "sequence_id long, n long, n_distinct long")
    all_ = written(each.groupBy("sequence_id").agg(F.sum("n").alias("n"), F.sum("n_distinct").alias("n_distinct"), F.count(F.lit(1)).alias("rows")), "totals")
    shared = all_.where("rows > 1").select(F.col("sequence_id").alias("id"))
    if shared.isEmpty():
        return all_.drop("rows")
    of_several = gram_table(rows.join(shared, F.col("sequence_id").eqNullSafe(F.col("id")), "left_semi"), n, drop_last)
    counted = of_several.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gram").alias("n_distinct"))
    return all_.where("rows = 1").drop("rows").union(counted)


def gram_hashes(sequences: DataFrame, n: int, drop_last: bool = False) -> DataFrame:
    """sequence_id, offset, gram_hash: the polynomial hash of every window; the tokens themselves go no further."""
    return _hashed(sequences, n, drop_last, None)


def _check(n: int, offset: int = 0) -> None:
    if n < 1 or offset < 0:
        raise ValueError(f"windows of {n} tokens from offset {offset} on")


def _hashed(sequences: DataFrame, n: int, drop_last: bool, wanted: membership.Slices | None) -> DataFrame:
    _check(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in windows.parts(batch.column(1), n, drop_last):
                hashes = windows.polynomial_hashes(part.tokens, n)[part.start]
                keep = np.arange(len(hashes)) if wanted is None else np.flatnonzero(wanted.passes(hashes))
                ids = batch.column(0).slice(part.rows.start, part.rows.stop - part.rows.start).take(pa.array(part.row[keep]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(part.offset[keep].astype(np.int32)), pa.array(hashes[keep])], names=["sequence_id", "offset", "gram_hash"])

    return sequences.select(F.col("sequence_id").cast("long").alias("sequence_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "sequence_id long, offset int, gram_hash long")


def grams_at(hashes: DataFrame, offset: int) -> DataFrame:
    """Distinct hashes that occur at an offset."""
    return hashes.where(F.col("offset") == offset).select("gram_hash").distinct()


def keep_grams(hashes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Windows whose hash is in a table."""
    return hashes.join(wanted.select("gram_hash"), "gram_hash", "left_semi")


def windows_of(sequences: DataFrame, wanted: DataFrame, n: int, drop_last: bool = False) -> DataFrame:
    """sequence_id, offset and gram_hash of the windows whose hash is in a table; windows are narrowed to them before they are moved."""
    wanted = written(wanted.select("gram_hash").distinct(), "wanted")
    found = None
    for slices in membership.scans(wanted.select(F.col("gram_hash").alias("key"))):
        one = _hashed(sequences, n, drop_last, slices)
        found = one if found is None else found.union(one)
    return keep_grams(found, wanted)


def approximate_duplicates(sequences: DataFrame, n: int, least: int = 2, drop_last: bool = False) -> DataFrame:
    """gram_hash, n and the positions of hashes that occur at least ``least`` times.

    Counts come first (combined before the shuffle); then only windows of hashes that repeat are moved.
    """
    often = gram_hashes(sequences, n, drop_last).groupBy("gram_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    often = written(often, "often")
    return windows_of(sequences, often, n, drop_last).join(often, "gram_hash").select("gram_hash", "n", "sequence_id", "offset")


def keyed_windows(sequences: DataFrame, n: int, drop_last: bool = False, wanted: membership.Slices | None = None, offset: int | None = None, keys: Keys = windows.window_keys) -> DataFrame:
    """sequence_id, offset, key and gram of the windows of n tokens: of those whose key may be wanted, or of those at one offset."""
    _check(n, offset or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in windows.parts(batch.column(1), n, drop_last):
                key = keys(part.tokens, n)[part.start].view(np.int64)
                keep = np.ones(len(key), bool) if wanted is None else wanted.passes(key)
                if offset is not None:
                    keep &= part.offset == offset
                keep = np.flatnonzero(keep)
                ids = batch.column(0).slice(part.rows.start, part.rows.stop - part.rows.start).take(pa.array(part.row[keep]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(part.offset[keep].astype(np.int32)), pa.array(key[keep]), windows.grams(part, keep, n)], names=["sequence_id", "offset", "key", "gram"])

    return sequences.select(F.col("sequence_id").cast("long").alias("sequence_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "sequence_id long, offset int, key long, gram array<int>")


def gram_counts(sequences: DataFrame, wanted: DataFrame, n: int, drop_last: bool = False, keys: Keys = windows.window_keys) -> DataFrame:
    """key, gram and how often each wanted gram (rows of key and gram) occurs at any offset of any sequence.

    Tokens travel with the windows that pass the filter only, and are a part of the group, so grams that share a key are counted apart.
    """
    wanted = written(wanted.select("key", "gram").distinct(), "wanted")
    found = None
    for slices in membership.scans(wanted.select("key").distinct()):
        one = keyed_windows(sequences, n, drop_last, slices, keys=keys).select("key", "gram")
        found = one if found is None else found.union(one)
    return found.groupBy("key", "gram").agg(F.count(F.lit(1)).alias("times")).join(wanted, ["key", "gram"], "left_semi")


def continuation_duplicates(sequences: DataFrame, offset: int = 32, n: int = 32, drop_last: bool = False, keys: Keys = windows.window_keys) -> DataFrame:
    """sequence_id and how often its n tokens at the offset occur at any offset of any sequence, itself included; 1 without them."""
    mine = written(keyed_windows(sequences, n, offset=offset, keys=keys).drop("offset"), "continuations")
    counts = gram_counts(sequences, mine, n, drop_last, keys)
    # Ids are expected to be unique, as everywhere in this module.
    found = mine.join(counts, ["key", "gram"], "left").select("sequence_id", "times")
    return sequences.select("sequence_id").join(found, "sequence_id", "left").select("sequence_id", F.coalesce("times", F.lit(1)).alias("sequence_duplicates"))


def unique_prefixes(sequences: DataFrame, n: int = 64) -> DataFrame:
    """The least sequence_id of each distinct prefix of n tokens."""
    return sequences.groupBy(F.slice("tokens", 1, n).alias("prefix")).agg(F.min("sequence_id").alias("sequence_id")).select("sequence_id")


def fill_counts(ids: DataFrame, counts: DataFrame, default: int = 1) -> DataFrame:
    """Every id with its count, or the default."""
    return ids.join(counts, "sequence_id", "left").select("sequence_id", F.coalesce("count", F.lit(default)).alias("count"))


def duplicate_groups(rows: DataFrame, content: str, id: str) -> DataFrame:
    """Contents that occur under more than one id: their number of ids and the least id."""
    return rows.groupBy(content).agg(F.count_distinct(id).alias("n_ids"), F.min(id).alias("first_id")).where("n_ids > 1")


def keep_first(rows: DataFrame, key: str, *order) -> DataFrame:
    """One row for each key: the first in a stated order (dropDuplicates has none)."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
