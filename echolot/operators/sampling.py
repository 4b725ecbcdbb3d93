"""Samples and splits that are the same on every run: rows are ordered by a hash of their id and a seed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import mix
from .ordering import row_places


def hash_order(id: str, seed: int) -> list[Column]:
    """A fixed pseudo-random order, with the id itself to settle ties."""
    return [F.md5(F.concat_ws("-", F.col(id).cast("string"), F.lit(str(seed)))), F.col(id)]


def sample_rows(rows: DataFrame, n: int, id: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer)."""
    return rows.orderBy(*hash_order(id, seed)).limit(n)


def sample_per_group(rows: DataFrame, n: int, group: Column, id: str, seed: int = 42) -> DataFrame:
    """At most n rows of each group; Spark drops the rest before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*hash_order(id, seed)))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def _placed(rows: DataFrame, group: str, id: str, seed: int) -> DataFrame:
    """The rows with their place in the hash order of their group (__place) and its size (__n)."""
    digest, own = hash_order(id, seed)
    return row_places(rows, [group], {"__hash": digest, "__id": own})


def balance_groups(rows: DataFrame, group: str, id: str, seed: int = 42) -> DataFrame:
    """Every group cut to the size of the smallest."""
    least = rows.groupBy(group).count().agg(F.min("count").alias("__least"))  # one row
    return _placed(rows, group, id, seed).crossJoin(F.broadcast(least)).where("__place < __least").drop("__place", "__n", "__least")


def stratified_split(rows: DataFrame, stratum: str, id: str, bounds: list[float], seed: int = 42) -> DataFrame:
    """Adds split: 0 for the first share of each stratum in hash order, 1 up to the next bound, and so on."""
    place = F.col("__place") / F.col("__n")
    split = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        split = F.when(place < bounds[k], k).otherwise(split)
    return _placed(rows, stratum, id, seed).withColumn("split", split).drop("__place", "__n")


def fold_of(id: str, folds: int, seed: int = 42) -> Column:
    """Fold of a row by its hash: about equal folds without any sort or shuffle."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.col(id).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.lit(folds))


def bootstrap_rows(rows: DataFrame, replicates: int, id: str, seed: int = 42) -> DataFrame:
    """Poisson bootstrap: each row n ~ Poisson(1) times in each replicate, drawn from its hash, so no row needs to know another."""
    drawn = F.pmod(F.xxhash64(F.col(id), F.col("replicate"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cumulative = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253]
    times = sum(((drawn >= c).cast("int") for c in cumulative[1:]), (drawn >= cumulative[0]).cast("int"))
    out = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("__times", times)
    return out.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__copy")


#: P(Poisson(1) <= k) for k = 0, 1, ...; fixed by the distribution.
_CUMULATIVE = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])
#: Sums that a task holds before it hands them on, and draws that it makes at once.
HELD, DRAWS = 1 << 22, 1 << 21


def poisson_weights(ids: np.ndarray, replicates: int, seed: int = 42) -> np.ndarray:
    """rows x replicates: how often each row is in each replicate, from its 64-bit id alone."""
    base = mix(ids.view(np.uint64) + mix(np.array([seed], np.uint64)))[:, None]
    step = mix(np.arange(1, replicates + 1, dtype=np.uint64))
    u = (mix(base ^ step) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.searchsorted(_CUMULATIVE, u, "right").astype(np.int8)


def bootstrap_sums(rows: DataFrame, sums: dict[str, Column], replicates: int, id: str, *keys: str, seed: int = 42) -> DataFrame:
    """keys, replicate and the sum of each column over a Poisson resample of the rows of each group.

    A row's weights in all replicates are one vector, and a task adds vector by value into arrays by group: no row is copied, and a task
    hands on one row for each group and replicate (more often only where its groups exceed ``HELD`` sums).  A null value adds
    nothing; rows of equal id get equal weights; a group that a replicate draws nothing from has sums of zero.
    """
    names = list(sums)
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema.fields}
    held = rows.select(F.xxhash64(F.col(id)).alias("__id"), *(c.cast("double").alias(f"__{i}") for i, c in enumerate(sums.values())), *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            groups = list(total)
            columns = [pa.array([g[i] for g in groups], kind).take(pa.array(np.repeat(np.arange(len(groups)), replicates))) for i, kind in enumerate(types)]
            values = np.concatenate([total[g] for g in groups]) if groups else np.zeros((0, len(names)))
            out = pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(replicates, dtype=np.int32), len(groups))), *(pa.array(np.ascontiguousarray(x)) for x in values.T)], names=[*keys, "replicate", *names])
            total.clear()
            return out

        types: list[pa.DataType] = []
        for batch in batches:
            types = [c.type for c in batch.columns[1 + len(names) :]]
            code = np.zeros(batch.num_rows, np.int64)
            for c in batch.columns[1 + len(names) :]:
                d = c.dictionary_encode()
                code = code * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy().astype(np.int64)
                code = np.unique(code, return_inverse=True)[1]
            _, first, group = np.unique(code, return_index=True, return_inverse=True)
            keys_of = [tuple(c[int(i)].as_py() for c in batch.columns[1 + len(names) :]) for i in first]
            ids = batch.column(0).to_numpy()
            values = np.stack([c.fill_null(0.0).to_numpy() for c in batch.columns[1 : 1 + len(names)]], axis=1)
            order = np.argsort(group, kind="stable")
            edge = np.searchsorted(group[order], np.arange(len(first) + 1))
            step = max(1, DRAWS // replicates)
            for k, key in enumerate(keys_of):
                for lo in range(edge[k], edge[k + 1], step):
                    own = order[lo : min(lo + step, edge[k + 1])]
                    got = poisson_weights(ids[own], replicates, seed).T.astype(float) @ values[own]
                    total[key] = total[key] + got if key in total else got
                if len(total) * replicates * len(names) > HELD:
                    yield flush()
        if total:
            yield flush()

    schema = ", ".join([*(f"`{k}` {t}" for k, t in kinds.items()), "replicate int", *(f"`{n}` double" for n in names)])
    return held.mapInArrow(run, schema).groupBy(*keys, "replicate").agg(*(F.sum(n).alias(n) for n in names))
