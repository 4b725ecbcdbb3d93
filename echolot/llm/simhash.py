"""SimHash near-duplicates by a Gray-order hierarchical index.

1. A text's fingerprint has a bit for each of the 64 bits of its shingles' XXH64 hashes: whether over half of them have it set.
   Shingles are hashed and their bits counted for a whole chunk at once, eight counters to an integer.
2. Equal fingerprints are one node (grouped with the smallest id, combined before the shuffle), so copies cost one row.
3. Nodes within ``distance`` bits of each other agree in at least one of distance + 1 blocks of the bits, so each node is dealt
   to that many groups, one for each block's mask and value.  A group of more than ``most`` nodes (counted exactly) is dealt out
   again by blocks of the bits in which its nodes differ: the argument holds there too, so no pair is lost, and distinct
   nodes run out of bits to share.  No group of unbounded size reaches a task, and no group is cut.
4. The groups of a batch are indexed together: nodes in Gray order, 8 to an inner node, 8 of these to the next one, up to a root
   for each group.  An inner node knows the bits in which all below it agree, and keeps of them those that its parent doesn't have
   yet.  Each member goes down from its root; differences add up on the way, and a subtree is left once they exceed ``distance``.
5. Of what a group links only a spanning forest leaves the task, so a group gives fewer edges than it has members, never all
   its pairs.  Components of these edges are those of all links.

Defined cases: a text without words (or null, or empty) has fingerprint zero and is linked like any other; one with fewer words
than a shingle is one shingle; a very long text is a chunk of its own and is hashed whole; rows that share an id are one node
of the result, linked by any of their fingerprints, and each keeps its own row; rows with a null id are linked with nothing and
have a null component; an empty table gives an empty result; columns other than id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .neardup import components, forest
from .textops import LOWER, Chunk, chunks, inside, mix, ragged, range_hash, words

WORDS, DISTANCE = 3, 3
#: Nodes of a group that are searched together; larger groups are dealt out again.
MOST = 16384
#: Children of an inner node.
FANOUT = 8
#: Pairs of a member and a node that are compared at once.
PAIRS = 1 << 20

_BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of k words, A-Z lower-cased and joined by one space, and the row of each, in order of rows."""
    low = LOWER[c.data]
    w = words(c, low)
    size = w.end - w.start
    end = np.cumsum(size + 1) - 1
    joined = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    word, at = ragged(size)
    joined[(end - size)[word] + at] = low[w.start[word] + at]
    count = np.diff(w.first)
    first = np.concatenate((inside(w.first, k), w.first[:-1][(count > 0) & (count < k)])).astype(np.int64)
    first.sort()
    row = w.row[first]
    last = np.minimum(first + k, w.first[row + 1]) - 1
    return range_hash(joined, (end - size)[first], end[last]), row


def bit_counts(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many of each row's hashes have each bit set: an array of n rows of 64, the lowest bit first.  Rows must be in order."""
    out = np.zeros((n, 64), np.int64)
    if not len(h):
        return out
    # Parts of one row of at most 255 hashes, so that a byte can count them.
    size = np.bincount(row, minlength=n)
    edge = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(len(h)) - edge[row]
    parts = np.flatnonzero(at % 255 == 0)
    of = row[parts]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    for j in range(8):
        counts = np.add.reduceat((h >> np.uint64(j)) & _BYTES, parts)
        out[of[begin], j::8] = np.add.reduceat(counts.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), begin)
    return out


def fingerprint_bits(c: Chunk, k: int = WORDS) -> np.ndarray:
    """Fingerprint of each text of a chunk."""
    h, row = shingle_hashes(c, k)
    more = 2 * bit_counts(h, row, c.n) > np.bincount(row, minlength=c.n)[:, None]
    return np.packbits(more, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(fingerprint_bits(c, k).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the order of the binary-reflected Gray code."""
    out = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def split_mask(mask: int, parts: int) -> list[int]:
    """The bits outside a mask in ``parts`` blocks of about equal size, each together with the mask; fewer if bits run out."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def deal(rows: DataFrame, distance: int) -> DataFrame:
    """Rows of fp and mask, each for the blocks of the bits outside its mask: fp, the larger mask, and the key of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, mask = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            kinds, of = np.unique(mask, return_inverse=True)
            for wide in zip(*(split_mask(int(m), distance + 1) for m in kinds), strict=True):
                own = np.array(wide, np.uint64)[of]
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(own.view(np.int64)), pa.array(mix(mix(fp & own) + own).view(np.int64))], names=["fp", "mask", "key"])

    return rows.select("fp", "mask").mapInArrow(run, "fp long, mask long, key long")


def _levels(fp: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the roots down: pattern, new mask, first child and number of children of each node.  The children of the last level are places in fp."""
    low, high = fp, fp  # AND and OR of what is below
    up = []
    while True:
        nodes = -(-size // FANOUT)
        group, at = ragged(nodes)
        first = (np.cumsum(size) - size)[group] + at * FANOUT
        below = np.minimum(FANOUT, size[group] - at * FANOUT)
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        up.append([low, ~(low ^ high), first, below])
        size = nodes
        if size.max() == 1:
            break
    for (_, mask, _, _), (_, above, _, below) in zip(up, up[1:], strict=False):
        mask &= ~np.repeat(above, below)
    return [tuple(x) for x in reversed(up)]


def neighbours(fp: np.ndarray, size: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of one group that differ in at most ``distance`` bits.  Groups lie one after another, each in Gray order."""
    levels = _levels(fp, size)
    group = np.repeat(np.arange(len(size)), size)
    # A member meets all of its group, so few enough members start together to bound what they meet.
    meets = np.concatenate(([0], np.cumsum(size[group])))
    lo = 0
    while lo < len(fp):
        hi = max(lo + 1, int(np.searchsorted(meets, meets[lo] + PAIRS, "right")) - 1)
        who, node, far = np.arange(lo, hi), group[lo:hi], np.zeros(hi - lo, np.uint8)
        for pattern, mask, first, below in levels:
            far = far + np.bitwise_count((fp[who] ^ pattern[node]) & mask[node])
            near = far <= distance
            pair, at = ragged(below[node[near]])
            who, far, node = who[near][pair], far[near][pair], first[node[near]][pair] + at
            later = node > who if first is levels[-1][2] else slice(None)  # each pair once
            who, far, node = who[later], far[later], node[later]
        close = np.bitwise_count(fp[who] ^ fp[node]) <= distance
        yield who[close], node[close]
        lo = hi


def group_edges(groups: DataFrame, distance: int) -> DataFrame:
    """u, v: a spanning forest of the links in each group, from rows of key and fp that are sorted by key."""

    def search(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(fp), key))
        key, fp = key[order], fp[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        root = forest(len(fp), neighbours(fp, np.diff(np.append(begin, len(fp))), distance))
        tied = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[tied].view(np.int64)), pa.array(fp[root[tied]].view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = np.append(key, batch.column(0).to_numpy()), np.append(fp, batch.column(1).to_numpy().view(np.uint64))
            cut = int(np.searchsorted(key == key[-1], True))  # the last group may go on
            if cut:
                yield search(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(fp):
            yield search(key, fp)

    return groups.select("key", "fp").mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """u, v: edges whose components are those of all pairs of distinct fingerprints (fp) within ``distance`` bits."""
    rows, found = nodes.select("fp", F.lit(0).cast("long").alias("mask")), None
    most = max(most, 2 << distance)  # so that a larger group has a free bit for each block
    while True:
        dealt = written(deal(rows, distance), "gray")
        agreed = F.bitwise_not(F.bit_and("fp").bitwiseXOR(F.bit_or("fp")))
        counts = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), agreed.alias("agreed")).where("n > 1")
        # Written, so that the join deals out both sides itself and Spark can split the rows of one key.
        met = dealt.join(written(counts, "gray"), "key")
        small = met.where(F.col("n") <= most).select("key", "fp").repartition("key").sortWithinPartitions("key")
        edges = group_edges(small, distance)
        found = edges if found is None else found.union(edges)
        # Distinct, as a group may be reached by several blocks.
        rows = written(met.where(F.col("n") > most).select("fp", F.col("mask").bitwiseOR(F.col("agreed")).alias("mask")).distinct(), "gray")
        if rows.isEmpty():
            return written(found.distinct(), "gray")


def near_duplicates(docs: DataFrame, k: int = WORDS, distance: int = DISTANCE, id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable) of every row."""
    prints = written(fingerprints(docs, k, id, text), "prints")
    whole = prints.where("doc_id is not null")
    nodes = written(whole.groupBy("fp").agg(F.min("doc_id").alias("node")), "prints")
    by_fp = links(nodes, distance, most)
    u, v = (nodes.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node")) for c in "uv")
    edges = by_fp.join(u, "u").join(v, "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    member = prints.join(nodes, "fp", "left").withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node")))
    # An id with several rows ties the fingerprints of its rows together.
    shared = whole.groupBy("doc_id").agg(F.count_distinct("fp").alias("n")).where("n > 1").select("doc_id")
    ties = member.join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    tree = components(edges.union(ties))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return member.join(tree, "node", "left").select("doc_id", digits.alias("fingerprint"), F.coalesce("component", "node").alias("component_id"))
