"""Token frequencies and the statistics of a sequence's token frequencies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import windows

#: A table of token values up to this many rows (a vocabulary of 16-bit ids) is sent to the tasks whole; a larger one is joined.
VOCABULARY_ROWS = 1 << 16


def token_counts(sequences: DataFrame, memorized: DataFrame | None = None, id: str = "sequence_id") -> DataFrame:
    """token_id, memorized, non_memorized: occurrences in sequences whose id is in the memorized table, and in others.

    Tokens are counted per task before the shuffle, so a token in every sequence is one row of each task.
    """
    if memorized is not None:
        marks = memorized.select(id).distinct().withColumn("is_memorized", F.lit(True))
        sequences = sequences.join(marks, id, "left")
    else:
        sequences = sequences.withColumn("is_memorized", F.lit(False))
    tokens = sequences.select(F.coalesce("is_memorized", F.lit(False)).alias("m"), F.explode("tokens").alias("token_id"))
    return tokens.groupBy("token_id").agg(F.count_if("m").alias("memorized"), F.count_if(~F.col("m")).alias("non_memorized"))


def token_probabilities(counts: DataFrame) -> DataFrame:
    """Adds all occurrences, the memorized share (0 for none) and the unigram perplexity (1e20 for none).  The total is one row."""
    every = F.col("memorized") + F.col("non_memorized")
    total = counts.agg(F.sum(every).alias("total"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("occurrences", every)
    return out.select(
        "token_id",
        "occurrences",
        F.coalesce(F.try_divide(F.col("memorized").cast("double"), F.col("occurrences")), F.lit(0.0)).alias("memorized_probability"),
        F.coalesce(F.try_divide(F.col("total").cast("double"), F.col("occurrences")), F.lit(1e20)).alias("unigram_perplexity"),
    )


@dataclass
class TokenValues:
    """Columns of a bounded table by token id: the ids in order, and the values of each column in their order."""

    ids: np.ndarray
    columns: dict[str, np.ndarray]

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each token in the columns, and whether it has one."""
        at = np.minimum(np.searchsorted(self.ids, tokens), max(len(self.ids) - 1, 0))
        return at, self.ids[at] == tokens if len(self.ids) else np.zeros(len(tokens), bool)


def token_values(table: DataFrame, most: int = VOCABULARY_ROWS) -> TokenValues | None:
    """The table (token_id and number columns, one row a token) in memory, or None if it has more than ``most`` rows; one bounded job."""
    rows = table.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return None
    ids = rows.column("token_id").to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    return TokenValues(ids[order], {c: rows.column(c).to_numpy()[order] for c in rows.column_names if c != "token_id"})


def known_frequencies(memorized: DataFrame, non_memorized: DataFrame) -> DataFrame:
    """token_id and memorized + non_memorized frequency of the tokens that both tables have."""
    both = memorized.select("token_id", F.col("frequency").alias("m")).join(non_memorized.select("token_id", F.col("frequency").alias("n")), "token_id")
    return both.select("token_id", (F.col("m") + F.col("n")).alias("frequency"))


#: The columns that statistics add, and their types.
STATISTICS = {"max_frequency": "long", "avg_frequency": "double", "min_frequency": "long", "median_frequency": "double", "p25_frequency": "long", "p75_frequency": "long", "frequencies": "array<long>"}


def _statistics(tokens: pa.ListArray, values: TokenValues) -> list[pa.Array]:
    """STATISTICS of each list, for a whole part of a batch: one sort by list and value, then places in it."""
    (part,) = windows.parts(tokens, 1, whole=True)
    at, known = values.find(part.tokens)
    f = values.columns["frequency"][at] if len(values.ids) else np.zeros(len(at), np.int64)
    n_all = np.bincount(part.row, minlength=len(tokens))
    row, have = part.row[known], f[known]
    order = np.lexsort((have, row))
    have = have[order].astype(np.int64)
    n = np.bincount(row, minlength=len(tokens))
    first = np.cumsum(n) - n
    some = np.flatnonzero(n)
    count = n[some]

    def column(x: np.ndarray) -> pa.Array:
        out = np.zeros(len(tokens), x.dtype)
        out[some] = x
        return pa.array(out, mask=n == 0)

    pick = lambda place: have[first[some] + place]
    total = np.add.reduceat(have, first[some]) if len(some) else have
    quarter = lambda share: pick(np.maximum(np.ceil(count * share).astype(np.int64), 1) - 1)
    off = np.concatenate(([0], np.cumsum(n_all))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(off, mask=np.append(n_all == 0, False)), pa.array(f.astype(np.int64), mask=~known))
    middle = (pick((count - 1) // 2) + pick(count // 2)) / 2.0
    return [column(x) for x in (pick(count - 1), total / np.maximum(count, 1), pick(0), middle, quarter(0.25), quarter(0.75))] + [lists]


def frequency_statistics(sequences: DataFrame, memorized: DataFrame, non_memorized: DataFrame, most: int = VOCABULARY_ROWS) -> DataFrame:
    """The sequences with max, avg, min, median, p25, p75 and the ordered list of their token frequencies.

    A token's frequency is memorized + non_memorized, null if either table lacks it.  Every row keeps its place and gets its own
    statistics, in the stage that reads it: tokens look their frequencies up and aren't moved.  A row without tokens has nulls.  The median is
    exact; p25 and p75 are elements.  Of a vocabulary of more than ``most`` tokens frequencies and tokens meet in a join instead; there
    ids are expected to be unique.
    """
    table = known_frequencies(memorized, non_memorized)
    values = token_values(table, most)
    if values is None:
        lists = _joined(sequences, table).groupBy("sequence_id").agg(F.collect_list(F.struct("position", "frequency")).alias("_x"))
        lists = lists.select("sequence_id", F.transform(F.array_sort("_x"), lambda x: x["frequency"]).alias("_f"))
        return with_array_statistics(sequences.join(lists, "sequence_id", "left"), sequences.columns)
    return _per_row(sequences, STATISTICS, lambda tokens: _statistics(tokens, values))


def _per_row(sequences: DataFrame, more: dict[str, str], make) -> DataFrame:
    """The rows with further columns that a function of their token lists gives, a part of each Arrow batch at a time."""
    place = sequences.columns.index("tokens")
    out = T.StructType([*sequences.schema.fields, *T.StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in more.items())).fields])
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(place).cast(pa.list_(pa.int64()))
            for part in windows.parts(tokens, 1):
                n = part.rows.stop - part.rows.start
                made = make(tokens.slice(part.rows.start, n))
                columns = [batch.column(i).slice(part.rows.start, n) for i in range(batch.num_columns)] + made
                yield pa.RecordBatch.from_arrays([x if x.type == f.type else x.cast(f.type) for x, f in zip(columns, kinds, strict=True)], schema=kinds)

    return sequences.mapInArrow(run, out)


def _joined(sequences: DataFrame, values: DataFrame) -> DataFrame:
    """sequence_id, position and token with the columns of a table of any size."""
    return sequences.select("sequence_id", F.posexplode("tokens").alias("position", "token_id")).join(values, "token_id", "left")


def token_lists(sequences: DataFrame, table: DataFrame, names: dict[str, str], most: int = VOCABULARY_ROWS) -> DataFrame:
    """sequence_id, tokens (those that the table has) and lists of the table's columns, in the order of the tokens.  names: column -> type.

    A sequence without such tokens has no row.
    """
    values = token_values(table.select("token_id", *names), most)
    if values is None:
        rows = _joined(sequences, table).where(" or ".join(f"{c} is not null" for c in names))
        lists = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("position", "token_id", *names))).alias("x"))
        return lists.select("sequence_id", F.col("x.token_id").cast("array<long>").alias("tokens"), *(F.col(f"x.{c}").alias(c) for c in names))

    def make(tokens: pa.ListArray) -> list[pa.Array]:
        (part,) = windows.parts(tokens, 1, whole=True)
        at, known = values.find(part.tokens)
        off = np.concatenate(([0], np.cumsum(np.bincount(part.row[known], minlength=len(tokens))))).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(off), pa.array(x)) for x in (part.tokens[known], *(v[at[known]] for v in values.columns.values()))]

    out = _per_row(sequences.select("sequence_id", "tokens"), {"__known": "array<long>"} | {c: f"array<{kind}>" for c, kind in names.items()}, make)
    return out.where(F.size("__known") > 0).select("sequence_id", F.col("__known").alias("tokens"), *names)


def frequency_statistics_in_place(sequences: DataFrame, memorized: dict[int, int], non_memorized: dict[int, int]) -> DataFrame:
    """The same for a vocabulary that fits a literal map: no explode and no shuffle."""
    pairs = [F.lit(x) for t in memorized.keys() & non_memorized.keys() for x in (t, memorized[t] + non_memorized[t])]
    lookup = F.create_map(*pairs) if pairs else F.create_map().cast("map<int,int>")
    found = F.transform("tokens", lambda t: F.element_at(lookup, t).cast("long"))
    return with_array_statistics(sequences.withColumn("_f", found), sequences.columns)


def with_array_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns and the statistics of the array _f, in which a null is a token without frequency."""
    known = F.array_sort(F.filter("_f", lambda x: x.isNotNull()))
    n = F.size("_k")
    at = lambda i: F.element_at("_k", i)
    some = F.when(n > 0, F.lit(True))
    rows = rows.withColumn("_k", known)
    half = ((n + 1) / 2).cast("int")
    return rows.select(
        *columns,
        F.array_max("_k").alias("max_frequency"),
        F.when(some, F.aggregate("_k", F.lit(0.0), lambda a, x: a + x) / n).alias("avg_frequency"),
        F.array_min("_k").alias("min_frequency"),
        F.when(some, (at(F.greatest(half, F.lit(1))) + at(F.greatest(n - half + 1, F.lit(1)))) / 2.0).alias("median_frequency"),
        F.when(some, at(F.greatest(F.ceil(n * 0.25).cast("int"), F.lit(1)))).alias("p25_frequency"),
        F.when(some, at(F.greatest(F.ceil(n * 0.75).cast("int"), F.lit(1)))).alias("p75_frequency"),
        F.when(F.size("_f") > 0, F.col("_f")).alias("frequencies"),
    )


def sequence_extremes(sequences: DataFrame, probabilities: DataFrame, n: int = 64, most: int = VOCABULARY_ROWS) -> DataFrame:
    """Extremes of the occurrences and the unigram perplexity of each sequence's first n tokens, as far as the table has them."""
    heads = sequences.select("sequence_id", F.slice("tokens", 1, n).alias("tokens"))
    lists = token_lists(heads, probabilities, {"occurrences": "long", "unigram_perplexity": "double"}, most)
    known = lists.select("sequence_id", *(f(c).alias(f"{name}_{short}") for c, short in (("occurrences", "occurrences"), ("unigram_perplexity", "perplexity")) for f, name in ((F.array_max, "max"), (F.array_min, "min"))))
    return heads.where(F.size("tokens") > 0).select("sequence_id").join(known, "sequence_id", "left")


def share_of(count: Column, *keys: str) -> Column:
    """A count over the sum of its group."""
    return count / F.sum(count).over(Window.partitionBy(*keys))
