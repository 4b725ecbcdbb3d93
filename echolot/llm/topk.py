"""Exact top-k inner products by dual-tree search over cover trees.

Queries are taken in blocks of bounded bytes; each block becomes a cover tree that is broadcast.  A task gathers its
candidate vectors in blocks and indexes each as a cover tree too.  Pairs of nodes are then visited together: the inner
product of any query and any candidate below them is at most  q.p + |q| R_p + |p| R_q + R_q R_p  with the nodes' centres and
covering radii, and if that is less, by more than rounding can make of it, than the worst k-th score of the query group the
pair is pruned.  Pairs of leaves are scored exactly, in integers where doubles could round.  First k-th scores come from a bounded sample of candidates, so pruning starts early; the tasks' best are
merged by a ranked window that drops rows before its shuffle.

Equal vectors are one point of the index with the k + 1 smallest of their ids: more can't be in a result.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; a query's candidates are the
vectors of its length; scores are exact while they fit a long; a null id takes no part; ties go to the smaller id; rows that repeat an id and its vector count once, rows
that repeat an id with another vector are candidates of their own and the query has the results of each; without queries or
candidates the result is empty; columns other than id and vector are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .textops import ragged

#: Bytes of query vectors broadcast at once, candidates indexed at once, candidates of a length that give the first scores.
QUERY_BYTES, CANDIDATE_BLOCK, SAMPLE = 16 << 20, 8192, 2048
#: A score that no pair has.
NONE = np.iinfo(np.int64).min
LEAF, FANOUT = 64, 12


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)

    def __post_init__(self):
        self.norm = float(np.sqrt(self.centre @ self.centre))


def cover_tree(x: np.ndarray, members: np.ndarray | None = None, centre: int = 0) -> Node:
    """Node over some rows of x.  Children's centres are chosen farthest first, the node's own first, until they cover the rows within half
    of its radius or FANOUT are reached; every row goes to its nearest centre, and radii are those of the rows that came."""
    members = np.arange(len(x)) if members is None else members
    own = x[members]
    far = np.sqrt(((own - x[centre]) ** 2).sum(axis=1))
    node = Node(x[centre], float(far.max(initial=0.0)), members)
    if len(members) <= LEAF or node.radius == 0:
        return node
    centres, near, which = [centre], far, np.zeros(len(members), np.int64)
    while near.max() > node.radius / 2 and len(centres) < FANOUT:
        new = int(members[near.argmax()])
        d = np.sqrt(((own - x[new]) ** 2).sum(axis=1))
        which[d < near] = len(centres)
        near = np.minimum(near, d)
        centres.append(new)
    if len(centres) > 1:
        node.children = [cover_tree(x, members[which == k], c) for k, c in enumerate(centres)]
    return node


class Best:
    """The best k scores and ids of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, NONE) if floor is None else floor  # no result scores less

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: rows x points; ids: points x ids of each (padded by -1)."""
        good = scores >= self.worst(rows)[:, None]
        k = self.score.shape[1]
        for i in np.flatnonzero(good.any(axis=1)):
            at = np.flatnonzero(good[i])
            new = ids[at]
            real = new >= 0
            s = np.concatenate((self.score[rows[i]], np.repeat(scores[i, at], real.sum(axis=1))))
            d = np.concatenate((self.id[rows[i]], new[real]))
            order = np.lexsort((d, ~s))[:k]
            self.score[rows[i]], self.id[rows[i]] = s[order], d[order]


def scores(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and p (whole doubles) as integers."""
    if q.size and p.size and np.abs(q).max() * np.abs(p).max() * q.shape[1] >= 1 << 53:
        return q.astype(np.int64) @ p.T.astype(np.int64)
    return (q @ p.T).astype(np.int64)


def search(q: np.ndarray, queries: Node, p: np.ndarray, ids: np.ndarray, points: Node, best: Best) -> None:
    stack = [(queries, points)]
    while stack:
        a, b = stack.pop()
        most = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        slack = 1e-9 * (a.norm + a.radius) * (b.norm + b.radius) + 1.0
        if most + slack < best.worst(a.members).min():
            continue
        if not a.children and not b.children:
            best.offer(a.members, scores(q[a.members], p[b.members]), ids[b.members])
        elif a.children and (not b.children or a.radius > b.radius):
            stack += [(x, b) for x in a.children]
        else:  # the most promising child is popped first
            stack += [(a, x) for x in sorted(b.children, key=lambda x: float(a.centre @ x.centre))]


def integer_vectors(table: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id and v: floor(scale * x) of each component, as whole doubles; only rows that take part."""
    x = F.col(vector)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(fine & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double")).alias("v"))


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    """Lists of length d as the rows of a matrix."""
    return col.flatten().to_numpy().reshape(-1, d)


def top_k(vectors: DataFrame, is_query, k: int = 5, id: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best candidates other than itself of every row for which is_query(id) holds."""
    ints = integer_vectors(vectors, id, vector)
    spark = vectors.sparkSession
    # The window's limit is applied before its shuffle too, so a vector that fills a third of the table stays k + 1 rows a task.
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = ints.distinct().withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = written(points, "points")  # read once for each block of queries
    asked = written(ints.where(is_query(F.col("id"))).distinct(), "queries")
    sizes = asked.groupBy(F.size("v").alias("d")).agg(F.count_distinct("v").alias("n")).collect()  # a row for each length
    parts = []
    for d, n in sorted(sizes):
        alike = points.where(F.size("v") == d)
        sample = alike.orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
        blocks = -(-8 * d * n // query_bytes)
        for b in range(blocks):
            mine = asked.select("v").where((F.size("v") == d) & (F.pmod(F.xxhash64("v"), F.lit(blocks)) == b)).distinct().toArrow()  # about query_bytes
            if mine.num_rows:
                parts.append(_search_block(alike, mine["v"].combine_chunks(), sample, k))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = functools.reduce(DataFrame.unionByName, parts)
    merged = found.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1).select("v", F.col("id").alias("vec_id"), "score")
    own = asked.withColumnRenamed("id", "query_id").join(merged, "v").where("query_id != vec_id")
    place = F.row_number().over(Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_block(points: DataFrame, queries: pa.Array, sample: pa.Table, k: int) -> DataFrame:
    """v, id and score: each task's k + 1 best points (all of the queries' length) for every query vector of a block."""
    d = len(queries[0])
    q, width = _matrix(queries, d), k + 1

    def id_matrix(col: pa.Array) -> np.ndarray:
        out = np.full((len(col), width), -1, np.int64)
        row, at = ragged(np.diff(col.offsets.to_numpy()))
        out[row, at] = col.flatten().to_numpy()
        return out

    tree = cover_tree(q)
    first = Best(len(q), width)
    p = _matrix(sample["v"].combine_chunks(), d)
    search(q, tree, p, id_matrix(sample["ids"].combine_chunks()), cover_tree(p), first)
    sent = points.sparkSession.sparkContext.broadcast((q, first.score[:, -1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor = sent.value
        tree, best = cover_tree(q), Best(len(q), width, floor)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            p, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            search(q, tree, p, ids, cover_tree(p), best)
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append((_matrix(batch.column(0), d), id_matrix(batch.column(1))))
            if sum(len(x) for x, _ in held) >= CANDIDATE_BLOCK:
                flush()
        if held:
            flush()
        row, col = np.nonzero(best.score > NONE)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(row) * d + 1, d, dtype=np.int32)), pa.array(q[row].ravel()))
        yield pa.RecordBatch.from_arrays([lists, pa.array(best.id[row, col]), pa.array(best.score[row, col])], names=["v", "id", "score"])

    return points.select("v", "ids").mapInArrow(run, "v array<double>, id long, score long")
