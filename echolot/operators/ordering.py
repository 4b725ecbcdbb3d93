"""Order statistics of groups of any size: sums before a row, the next row, and exact quantiles.

No group has to fit a task.  ``dealt`` puts rows in order over range partitions, so a large group lies in several of them; a running sum is
then one inside a partition plus the totals of the group's partitions before it, and a row's successor is the next row of its
partition or the first one of the group's next partition.  Quantiles are selected by digits: histograms of the leading 16 bits of
order-preserving integers say in which digit a wanted rank lies, and only values with that prefix go into the next histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Groups of up to so many values are left to Spark's percentile, which keeps a group's values in one task.
SMALL_GROUP = 1 << 19
_DIGIT = 16


def dealt(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows over range partitions of keys and order, with the number of their partition (__part); written, so that it stays."""
    return written(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ordered")


def _with_parts(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Joins a row for each partition and group to the rows of that partition and group; null keys are a group too."""
    same = F.col("a.__part") == F.col("b.__part")
    for k in keys:
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    more = [F.col(f"b.`{c}`") for c in parts.columns if c not in ("__part", *keys)]
    return rows.alias("a").join(parts.alias("b"), same).select("a.*", *more)


def sums_before(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Dealt rows with, under each new name, the sum of a column over the rows of the same keys that come before (0 for the first)."""
    part = Window.partitionBy("__part", *keys)
    inside = rows.withColumns({f"__in_{new}": F.coalesce(F.sum(c).over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for new, c in sums.items()})
    totals = rows.groupBy("__part", *keys).agg(*(F.sum(c).alias(new) for new, c in sums.items()))
    # A row for each partition that a group lies in.
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *keys, *(F.coalesce(F.sum(new).over(earlier), F.lit(0)).alias(f"__to_{new}") for new in sums))
    out = _with_parts(inside, offsets, keys)
    return out.withColumns({new: F.col(f"__in_{new}") + F.col(f"__to_{new}") for new in sums}).drop(*(f"__{x}_{new}" for new in sums for x in ("in", "to")))


def next_values(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Dealt rows with, under each new name, a column's value in the next row of the same keys (null for the last)."""
    part = Window.partitionBy("__part", *keys).orderBy(*order)
    last = F.lead(F.lit(1)).over(part).isNull()
    inside = rows.withColumns({f"__in_{new}": F.lead(c).over(part) for new, c in columns.items()} | {"__last": last})
    firsts = rows.groupBy("__part", *keys).agg(*(F.min_by(c, F.struct(*order)).alias(new) for new, c in columns.items()))
    later = Window.partitionBy(*keys).orderBy("__part")
    nexts = firsts.select("__part", *keys, *(F.lead(new).over(later).alias(f"__to_{new}") for new in columns))
    out = _with_parts(inside, nexts, keys)
    return out.withColumns({new: F.when(F.col("__last"), F.col(f"__to_{new}")).otherwise(F.col(f"__in_{new}")) for new in columns}).drop("__last", *(f"__{x}_{new}" for new in columns for x in ("in", "to")))


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit integers in the same order (unsigned); negative zero is zero."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_bits(bits: np.ndarray) -> np.ndarray:
    return np.where(bits >> np.uint64(63), bits ^ np.uint64(1 << 63), ~bits).view(np.float64)


def _as_bits(rows: DataFrame, columns: list[str]) -> DataFrame:
    """group, column (its place) and bits of every value that isn't null; NaN is larger than all, as in Spark's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(columns)):
                known = batch.column(i + 1).is_valid()
                values = batch.column(i + 1).filter(known).to_numpy()
                bits = ordered_bits(np.where(np.isnan(values), np.nan, values)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(known), pa.array(np.full(len(bits), i, np.int32)), pa.array(bits)], names=["g", "column", "bits"])

    # A group is a struct of its keys in text form of exact bits: Spark's hash of both, compared below by all of them.
    kind = rows.schema["g"].dataType.simpleString()
    return rows.select("g", *(F.col(c).cast("double") for c in columns)).mapInArrow(run, f"g {kind}, column int, bits long")


def quantiles(rows: DataFrame, columns: list[str], shares: list[float], *keys: str, small: int = SMALL_GROUP) -> DataFrame:
    """keys, column, share and value: exact quantiles of each column in each group, between neighbours by linear interpolation.

    Nulls don't count; a group without values has a null.  Groups of up to ``small`` rows are left to Spark's percentile.
    """
    names = {i: c for i, c in enumerate(columns)}
    pick = lambda number: F.element_at(F.array(*(F.lit(c) for c in columns)), number + 1)
    rows = rows.select(F.struct(*(F.col(k) for k in keys), F.lit(0).alias("__one")).alias("g"), *(F.col(c).cast("double").alias(f"__{i}") for i, c in names.items()))
    own = [f"__{i}" for i in names]
    sizes = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    large = sizes.where(F.col("n") > small).select("g")
    spread_keys = [F.col(f"g.`{k}`").alias(k) for k in keys]
    wanted = F.array(*map(F.lit, shares))
    by = rows.join(sizes.where(F.col("n") <= small).select("g"), "g").groupBy("g").agg(*(F.percentile(c, wanted).alias(c) for c in own))
    each = F.explode(F.array(*(F.struct(F.lit(names[i]).alias("column"), F.lit(q).alias("share"), F.col(f"__{i}")[k].alias("value")) for i in names for k, q in enumerate(shares))))
    out = by.select("g", each.alias("x")).select(*spread_keys, "x.*")
    if large.isEmpty():
        return out
    # Large groups are few (one for each ``small`` rows at most).
    bits = written(_as_bits(rows.join(large, "g", "left_semi"), own), "bits")
    counts = bits.groupBy("g", "column").agg(F.count(F.lit(1)).alias("n"))
    at = (F.col("n") - 1) * F.col("share")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.floor(at).alias("k")), F.struct(F.lit(1).alias("end"), F.ceil(at).alias("k"))))
    state = counts.select("g", "column", "n", F.explode(wanted).alias("share")).select("g", "column", "share", (at - F.floor(at)).alias("part"), ends.alias("e"))
    state = written(state.select("g", "column", "share", "part", "e.end", "e.k", F.lit(0).cast("long").alias("prefix")), "ranks")
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        values = bits.withColumn("prefix", F.shiftrightunsigned("bits", shift + _DIGIT) if shift + _DIGIT < 64 else F.lit(0).cast("long"))
        values = values.join(state.select("g", "column", "prefix").distinct(), ["g", "column", "prefix"], "left_semi")
        digit = F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        histogram = values.groupBy("g", "column", "prefix", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        # At most 65536 digits of a prefix.
        before = F.sum("n").over(Window.partitionBy("g", "column", "prefix").orderBy("digit")) - F.col("n")
        histogram = histogram.withColumn("before", before)
        met = state.join(histogram, ["g", "column", "prefix"]).where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n")))
        state = written(met.select("g", "column", "share", "part", "end", (F.col("k") - F.col("before")).alias("k"), F.shiftleft("prefix", _DIGIT).bitwiseOR(F.col("digit")).alias("prefix")), "ranks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(from_bits(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)))], names=[*batch.schema.names[:-1], "x"])

    kind = state.schema["g"].dataType.simpleString()
    found = state.select("g", "column", "share", "part", "end", "prefix").mapInArrow(decode, f"g {kind}, column int, share double, part double, end int, x double")
    value = (1 - F.first("part")) * F.max(F.when(F.col("end") == 0, F.col("x"))) + F.first("part") * F.max(F.when(F.col("end") == 1, F.col("x")))
    got = found.groupBy("g", "column", "share").agg(value.alias("value"))
    # A column without values has nulls, as Spark's percentile gives.
    every = large.select("g", F.explode(F.array(*map(F.lit, names))).alias("column")).select("g", "column", F.explode(wanted).alias("share"))
    got = every.join(got, ["g", "column", "share"], "left")
    return out.unionByName(got.select(*spread_keys, pick(F.col("column")).alias("column"), "share", "value"))


def quantile_columns(rows: DataFrame, wanted: dict[str, tuple[str, float]], *keys: str, small: int = SMALL_GROUP) -> DataFrame:
    """keys and, under each new name, the quantile of a column: one row a group."""
    long = quantiles(rows, sorted({c for c, _ in wanted.values()}), sorted({q for _, q in wanted.values()}), *keys, small=small)
    return long.groupBy(*keys).agg(*(F.max(F.when((F.col("column") == c) & (F.col("share") == q), F.col("value"))).alias(new) for new, (c, q) in wanted.items()))


def row_places(rows: DataFrame, keys: list[str], order: dict[str, Column]) -> DataFrame:
    """The rows with their place (from 0) among those of the same keys, in the given order, and how many these are (__n)."""
    one = rows.withColumns(order | {"__one": F.lit(1).cast("long")})
    out = sums_before(dealt(one, keys, list(order)), keys, list(order), {"__place": "__one"})
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return out.drop("__one", "__part", *order).alias("a").join(sizes.alias("b"), same).select("a.*", "b.__n")
