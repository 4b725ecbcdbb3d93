"""MinHash near-duplicates: one permutation, optimal densification, banded buckets and star-shaped candidate edges.

1. Every text becomes a set of word shingles.  One hash per shingle picks a bin and a value; the least value of each bin is
   the signature, and an empty bin takes the value of a filled one that a fixed hash sequence of the bin's number finds.
2. Texts with the same set are one node (grouped by a 128-bit hash of the set, combined before the shuffle), so thousands of
   copies cost one row from here on.
3. Bands of the signature are buckets.  A bucket of n nodes gives at most 2n edges: from each member to the one with the
   smallest set and to the one with the smallest id.  Every edge is checked on full sets.
4. Buckets that the links leave in several components go on.  If but a few members (STRAGGLERS) are outside the largest
   component, these are tried with all members of other components; a bounded number more (CROWD) in blocks, so that a member's
   text moves once a block and not once a pair.  Before any text moves, pairs that can't be similar enough go: |x & y| is at most
   min(|x & o|, |y & o|) + min(|x - o|, |y - o|) for any set o, and each member has been compared with one, its bucket's origin.
   A stranger in the bucket of a large group so costs numbers only.  Otherwise all members are held against one, the
   origin o (that which shares most buckets with others), and dealt out again into narrower buckets, by shingles that o lacks.
   Nothing is lost by that: a link of x and y takes p (|x| + |y|) / (100 + p) common shingles.  If |x & o| or |y & o| is less,
   they have some outside o in common, in fact so many that a prefix of x's shingles outside o must meet those of y.  The
   others, whose common part with o alone could do, are smaller than o and stay together as one bucket without o.  So every
   pair meets in a narrower or smaller bucket, and a crowd that has only its origin's shingles in common falls apart at once.
5. Components come from alternating large-star and small-star steps, after tasks have replaced their edges by spanning stars; later
   links join the components that are there already.

So every pair at the threshold that shares a bucket ends in one component, and no bucket gives all its pairs.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; one with fewer words than a
shingle has is one shingle; rows that share an id are one node and are linked by any of their sets, and each keeps a result
row with its own set size; rows with a null id are linked with nothing and have a null component; an empty table gives an
empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .textops import LOWER, Chunk, chunks, gram_hashes, inside, mix, ragged, repeated, seen_before, word_hashes, words

WORDS = 5
PERCENT = 80
#: 24 bands of 4 bins: a pair at 0.8 shares no band with probability 3e-6; at 0.3 it shares one with 0.18.
BANDS, BAND_BINS = 24, 4
#: Members outside a bucket's largest component that are tried with all others.
STRAGGLERS = 32
#: Members outside it that are tried with all others in blocks, from the second round on, and how many of both sides a block has.
CROWD, BLOCK, BLOCK_OTHERS = 1024, 64, 4096
#: Edges that a task replaces by their spanning stars at once.
EDGES = 1 << 17


def _kept(df: DataFrame) -> DataFrame:
    """The rows as a table: the rounds below build on it, and a plan that is read back carries nothing of how it came about."""
    return written(df, "near")


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of k words, A-Z lower-cased, in order of rows; a shorter text is one shingle."""
    low = LOWER[c.data]
    w = words(c, low)
    h = word_hashes(c, w, low)
    count = np.diff(w.first)
    at = inside(w.first, k)
    found, rows = [gram_hashes(h, k)[at]] if len(at) else [], [w.row[at]] if len(at) else []
    for m in range(1, k):
        if len(short := np.flatnonzero(count == m)):
            found.append(mix(gram_hashes(h, m)[w.first[short]] + np.uint64(m)))
            rows.append(short)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, row = np.concatenate(found), np.concatenate(rows)
    if len(rows) > 1:
        order = np.argsort(row, kind="stable")
        g, row = g[order], row[order]
    return g, row


def distinct_shingles(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    g, row = shingles(c, k)
    new = ~seen_before(g ^ mix(row.astype(np.uint64)))
    return g[new], row[new]


def signatures(g: np.ndarray, row: np.ndarray, n: int, bins: int) -> np.ndarray:
    """The n rows' signatures; rows without shingles stay empty."""
    place = ((g >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    sig = np.full(n * bins, _EMPTY, np.uint64)
    np.minimum.at(sig, row * bins + place.astype(np.int64), mix(g))
    base = sig.reshape(n, bins)
    out = base.copy()
    some = np.zeros(n, bool)
    some[row] = True
    r, b = np.nonzero((base == _EMPTY) & some[:, None])
    attempt = 1
    while len(r):
        take = (mix((b.astype(np.uint64) << np.uint64(32)) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        value = base[r, take]
        hit = value != _EMPTY
        out[r[hit], b[hit]] = value[hit]
        r, b, attempt = r[~hit], b[~hit], attempt + 1
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One bucket key for each row and band; the band's number is a part of it."""
    n, bins = sig.shape
    part = sig.reshape(n, bands, bins // bands)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for k in range(bins // bands):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part[:, :, k])
    return out


def sketch(docs: DataFrame, k: int = WORDS, id: str = "doc_id", text: str = "text", bands: int = BANDS, band_bins: int = BAND_BINS) -> DataFrame:
    """doc_id, n_shingles, two 64-bit hashes of the set, and the bucket keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                g, row = distinct_shingles(c, k)
                size = np.bincount(row, minlength=c.n)
                edge = np.concatenate(([0], np.cumsum(size)))
                sums = []
                for salt in (0x1234567, 0x89ABCDEF):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(g + np.uint64(salt)))))
                    sums.append(mix(total[edge[1:]] - total[edge[:-1]]).view(np.int64))
                keys = band_keys(signatures(g, row, c.n, bands * band_bins), bands).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.n * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(size), *map(pa.array, sums), lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _side_by_side(batch: pa.RecordBatch, k: int, step: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of pairs lo to hi of a batch (a, b, text_a, text_b): the distinct shingles, the row of each (twice the pair, and 1 for b) and whether its pair's other text has it too."""
    left, right = batch.column(2), batch.column(3)
    both = pa.concat_arrays([left, right]).take(pa.array(np.arange(2 * len(left)).reshape(2, -1).T.ravel()))
    for lo in range(0, len(left), step):
        part = both.slice(2 * lo, 2 * step)
        found = [(g, row + c.lo) for c in chunks(part) for g, row in (distinct_shingles(c, k),)]
        g, row = (np.concatenate(x) for x in zip(*found, strict=True))
        yield lo, lo + len(part) // 2, g, row, repeated(g ^ mix(row.astype(np.uint64) // np.uint64(2)))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")


def compared_pairs(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, common (shingles in both) and linked (100 * intersection >= percent * union of their full shingle sets) of pairs, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, _, row, both in _side_by_side(batch, k):
                size[lo:hi] = np.bincount(row // 2, minlength=hi - lo)
                common[lo:hi] = np.bincount(row[both] // 2, minlength=hi - lo) // 2
            linked = 100 * common >= percent * (size - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common), pa.array(linked)], names=["a", "b", "common", "linked"])

    return _kept(_with_texts(pairs, texts).mapInArrow(run, "a long, b long, common long, linked boolean"))


def outside(stars: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, linked, common, inside and keys, from rows of a, b and least (no set of a's star is smaller).

    inside: up to which set size of a partner the shingles that b shares with a could alone make a link.
    keys: shingles of b that a lacks; two members of the star that aren't both smaller than the other's ``inside`` and are
    similar enough have a key in common.  They are the first ones in a fixed order, as many as are sure to meet a partner's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, g, row, both in _side_by_side(batch, k):
                n = 2 * (hi - lo)
                size, common = np.bincount(row, minlength=n), np.bincount(row[both], minlength=n)[1::2]
                other, mine = size[::2], size[1::2]
                smallest = batch.column(4).to_numpy()[lo:hi]
                least = np.maximum(-(-percent * (mine + smallest) // (100 + percent)) - common, 1)
                out = np.flatnonzero(~both & (row % 2 == 1))
                out = out[np.lexsort((mix(g[out]), row[out]))]
                own = np.bincount(row[out] // 2, minlength=hi - lo)
                take = np.clip(own - least + 1, 0, own)
                pair, at = ragged(own)
                kept = g[out[at < take[pair]]].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))).astype(np.int32)), pa.array(kept))
                linked = 100 * common >= percent * (other + mine - common)
                ids = (batch.column(i).slice(lo, hi - lo) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(linked), pa.array(common), pa.array((100 + percent) * common // percent - mine), lists], names=["a", "b", "linked", "common", "inside", "keys"])

    with_texts = _with_texts(stars, texts).join(stars.select("a", "b", "least"), ["a", "b"])
    return _kept(with_texts.mapInArrow(run, "a long, b long, linked boolean, common long, inside long, keys array<long>"))


def crossed(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between the members outside a key's largest component and those of other components, from rows as _apart gives them.

    Blocks of both sides meet, so a task holds the sets of BLOCK members at a time; of a member's links with one component
    in a batch one is returned.
    """
    blocks, parts = F.ceil(F.col("rest") / BLOCK), F.ceil(F.col("n") / BLOCK_OTHERS)
    of = lambda count, *by: F.pmod(F.xxhash64(*by), count)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    some = members.where("component != most").select("key", "node", "component", of(blocks, "node").alias("block"), every(parts).alias("part"), F.lit(0).alias("side"))
    others = members.select("key", "node", "component", every(blocks).alias("block"), of(parts, "node", F.lit(1)).alias("part"), F.lit(1).alias("side"))
    rows = _kept(some.union(others).select(F.xxhash64("key", "block", "part").alias("group"), "side", F.col("node").alias("doc_id"), "component"))
    rows = rows.join(texts, "doc_id").select("group", "side", F.col("doc_id").alias("node"), "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            key, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (side[1:] != side[:-1]))) if len(key) else []
            for lo, hi in zip(edge, np.append(edge[1:], len(key)), strict=True):
                if key[lo] != group:
                    group, held = key[lo], []
                for at in range(lo, hi, 256):
                    own = batch.slice(at, min(256, hi - at))
                    found = [(g, row + c.lo) for c in chunks(own.column(4)) for g, row in (distinct_shingles(c, k),)]
                    sets = own.column(2).to_numpy(), own.column(3).to_numpy(), *(np.concatenate(x) for x in zip(*found, strict=True))
                    if side[lo] == 0:
                        held.append(sets)
                    elif held:
                        yield meet(held, sets)

    def meet(held: list[tuple], sets: tuple) -> pa.RecordBatch:
        if len(held) > 1:
            base = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
            held[:] = [(*(np.concatenate([h[i] for h in held]) for i in range(3)), np.concatenate([h[3] + b for h, b in zip(held, base, strict=True)]))]
        y, y_part, g, row = held[0]
        x, x_part, g_x, row_x = sets
        order = np.argsort(g, kind="stable")
        lo, hi = (np.searchsorted(g[order], g_x, side) for side in ("left", "right"))
        i, j = ragged(hi - lo)
        common = np.bincount(row_x[i] * len(y) + row[order[lo[i] + j]], minlength=len(x) * len(y)).reshape(len(x), len(y))
        total = np.bincount(row_x, minlength=len(x))[:, None] + np.bincount(row, minlength=len(y))
        b, a = np.nonzero((100 * common >= percent * (total - common)) & (common > 0) & (x_part[:, None] != y_part))
        once = np.flatnonzero(~seen_before(mix(a.astype(np.uint64)) ^ x_part[b].astype(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(y[a[once]]), pa.array(x[b[once]])], names=["a", "b"])

    return _kept(rows.repartition("group").sortWithinPartitions("group", "side").mapInArrow(run, "a long, b long").distinct())


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least place that each of n places is linked with, directly or through others."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _spanning(edges: DataFrame, rows: int) -> DataFrame:
    """u, v: the edges, each EDGES of a task replaced by an edge from every node to the smallest one that they tie it to."""

    def stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
        root = forest(len(nodes), [(place[: len(u)], place[len(u) :])])
        tied = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= EDGES:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return edges.select("u", "v").coalesce(-(-rows // EDGES)).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) of every node of the edges u, v.

    Tasks first shrink their own edges to spanning stars.  Then each large-star step ties the larger neighbours of a node to its smallest
    one, each small-star step the smaller ones; the result is reached when only stars around smallest nodes are left, after a number of
    rounds that grows with the logarithm of the longest path.
    """
    e = _kept(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if rows := e.count():
        e = _kept(_spanning(e, rows))
    while True:
        both = e.union(e.select("v", "u"))
        # Written, so that the join deals out both sides itself and Spark can split the edges of a node with very many.
        least = _kept(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("smaller"), F.count_if(F.col("v") > F.col("u")).alias("larger")))
        if least.where("smaller > 1 or (smaller = 1 and larger > 0)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        e = _kept(small)


def _grown(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after further edges u, v (a written table)."""
    return tree if edges.isEmpty() else components(edges.select("u", "v").union(tree.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def _pair(other: str, size: str) -> Column:
    """The node and another one, the one of the smaller set (then of the smaller id) first."""
    mine, its = F.struct(F.col("n_shingles").alias("s"), F.col("node").alias("x")), F.struct(F.col(size).alias("s"), F.col(other).alias("x"))
    return F.struct(F.least(mine, its)["x"].alias("a"), F.greatest(mine, its)["x"].alias("b"))


def _fits(size: str, percent: int) -> Column:
    """Whether set sizes alone don't rule a link out."""
    return 100 * F.least(size, "n_shingles") >= percent * F.greatest(size, "n_shingles")


def _known(rows: DataFrame, ends: DataFrame, compared: DataFrame) -> DataFrame:
    """The rows with the origin of their key and how many shingles they have in common with it (null where they weren't compared)."""
    each = rows.join(ends.select("key", "origin", "origin_size"), "key").withColumn("p", _pair("origin", "origin_size"))
    each = each.withColumns({"a": F.col("p.a"), "b": F.col("p.b")}).join(compared.select("a", "b", "common"), ["a", "b"], "left")
    return each.withColumn("common", F.when(F.col("node") == F.col("origin"), F.col("n_shingles")).otherwise(F.col("common"))).drop("a", "b", "p", "origin_size")


def _possible(members: DataFrame, percent: int) -> DataFrame:
    """key, node, n_shingles, x and s: members outside their key's largest component (x, of size s) with the members of other components, as far
    as set sizes and what both have in common with one origin leave a link possible."""
    out = members.where("component != most").select("key", F.col("component").alias("c"), F.col("node").alias("x"), F.col("n_shingles").alias("s"), F.col("origin").alias("x_origin"), F.col("common").alias("x_common"))
    shared = F.least(F.coalesce("common", "n_shingles"), F.coalesce("x_common", "s")) + F.least(F.coalesce(F.col("n_shingles") - F.col("common"), "n_shingles"), F.coalesce(F.col("s") - F.col("x_common"), "s"))
    could = (F.col("origin") != F.col("x_origin")) | ((100 + percent) * shared >= percent * (F.col("n_shingles") + F.col("s")))
    return members.join(_kept(out), "key").where((F.col("c") != F.col("component")) & _fits("s", percent) & could).select("key", "node", "n_shingles", "x", "s")


def _ends(members: DataFrame, origin: Column) -> DataFrame:
    """key, and node and size of the smallest set (centre) and of the member with the largest value of origin, of keys with several members."""
    centre, origin = F.min(F.struct("n_shingles", "node")), F.max(F.struct(origin.alias("by"), "node", "n_shingles"))
    ends = members.groupBy("key").agg(centre.alias("c"), origin.alias("o"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    return _kept(ends.select("key", F.col("c.node").alias("centre"), F.col("c.n_shingles").alias("centre_size"), F.col("o.node").alias("origin"), F.col("o.n_shingles").alias("origin_size")))


def _stars(members: DataFrame) -> DataFrame:
    """a, b and least: each member (b) with the origin of its bucket, the member whose buckets are together largest, and the smallest set of that origin's buckets."""
    sizes = _kept(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    met = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("met"))
    ends = _ends(_kept(members.join(met, "node")), F.col("met"))
    pairs = members.join(ends.select("key", F.col("origin").alias("a"), "centre_size"), "key").where("node != a")
    # The least size is gathered from the buckets, so that no task gets all of an origin's members for it.
    least = _kept(ends.groupBy(F.col("origin").alias("a")).agg(F.min("centre_size").alias("least")))
    return _kept(pairs.select("a", F.col("node").alias("b"), "n_shingles").distinct().join(least, "a"))


def _star(members: DataFrame, ends: DataFrame, percent: int) -> DataFrame:
    """a, b: each member with the two ends of its bucket, where set sizes allow a link."""
    each = F.array(*(F.when(_fits(f"{e}_size", percent), _pair(e, f"{e}_size")) for e in ("centre", "origin")))
    return members.join(ends, "key").select(F.explode(each).alias("p")).where("p.a != p.b").select("p.a", "p.b").distinct()


def _apart(members: DataFrame, tree: DataFrame) -> DataFrame:
    """Members of the keys that hold several components, with component, the largest one (most), how many there are (n) and how many outside the largest one (rest)."""
    known = members.join(tree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = _kept(mixed.select("key", "n", F.col("most.component").alias("most"), (F.col("n") - F.col("most.n")).alias("rest")))
    return _kept(known.join(mixed, "key"))


def _narrower(stars: DataFrame, found: DataFrame) -> DataFrame:
    """node, n_shingles, origin, common (shingles that are the origin's too) and key of the next buckets: an origin's members that share a shingle outside it, and those whose common part with it could alone make a link."""
    rows = found.join(stars, ["a", "b"]).withColumnRenamed("b", "node")
    kept = ["node", "n_shingles", F.col("a").alias("origin"), "common"]
    apart = rows.select(*kept, F.explode("keys").alias("g")).select("node", "n_shingles", "origin", "common", F.xxhash64("origin", "g").alias("key"))
    most = _kept(rows.groupBy("a").agg(F.max("inside").alias("all"), F.max(F.when(~F.col("linked"), F.col("inside"))).alias("unlinked")))
    # Of a pair that matters one is not linked with the origin.
    limit = F.when(F.col("linked"), F.col("unlinked")).otherwise(F.col("all"))
    inside = rows.join(most, "a").where((F.col("inside") >= F.col("least")) & (F.col("n_shingles") <= limit))
    return _kept(apart.union(inside.select(*kept, F.xxhash64("a", F.lit("inside")).alias("key"))).distinct())


def links(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """node and component of the nodes (smallest ids) of different sets that have links, from rows of node, n_shingles and bands.

    Links are verified, and join any two nodes that are similar enough and share a band.
    """
    edges = lambda pairs: pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    members = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    ends = _ends(members, -F.col("node"))
    members = _kept(members.join(ends.select("key"), "key", "left_semi"))
    texts = written(docs.select("doc_id", "text").join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    star = compared_pairs(_kept(_star(members, ends, percent)), texts, k, percent)
    tree = components(edges(star.where("linked")))
    first = True
    while True:
        apart = _apart(members, tree)
        few, many = apart.where(F.col("rest") <= STRAGGLERS), apart.where(F.col("rest") > STRAGGLERS)
        pairs = _kept(_possible(_known(few, ends, star) if first else few, percent).select(_pair("x", "s").alias("p")).select("p.a", "p.b").distinct())
        if not pairs.isEmpty():
            tree = _grown(tree, _kept(edges(compared_pairs(pairs, texts, k, percent).where("linked"))))
        if many.isEmpty():
            return tree
        if not first:
            tree = _grown(tree, edges(_crowds(many.where(F.col("rest") <= CROWD), texts, k, percent)))
            many = many.where(F.col("rest") > CROWD)
            if many.isEmpty():
                return tree
        first = False
        stars = _stars(many.select("node", "n_shingles", "key"))
        found = outside(stars, texts, k, percent)
        tree = _grown(tree, edges(found.where("linked")))
        members = _narrower(stars, found)


def _crowds(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: the links of crossed(), of the members that have a possible partner."""
    alive = _kept(_possible(members, percent).select("key", F.explode(F.array("node", "x")).alias("node")).distinct())
    if alive.isEmpty():
        return alive.select(F.col("key").alias("a"), F.col("node").alias("b"))
    left = members.drop("n", "rest").join(alive, ["key", "node"], "left_semi")
    sizes = _kept(left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("component") != F.col("most")).alias("rest")))
    return crossed(left.join(sizes, "key"), texts, k, percent)


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable) and kept (whether that is its own) for every row."""
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = _kept(sketch(docs, k))
    whole = sketches.where("n_shingles > 0 and doc_id is not null")
    # Written here, so that the join below deals out both sides itself and Spark can split the copies of one set.
    nodes = _kept(whole.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    member = sketches.drop("bands").join(nodes.drop("bands"), ["n_shingles", "set_a", "set_b"], "left").withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")))
    tree = links(docs, nodes, k, percent)
    # An id with several rows ties the sets of its rows together.
    shared = _kept(whole.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if not shared.isEmpty():
        tree = _grown(tree, _kept(member.join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))))
    out = member.join(tree, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def deduplicate(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with one document of each group: that of the smallest id; rows with a null id stay.

    Of rows that repeat the smallest id all stay.
    """
    gone = near_duplicates(docs, k, percent, id, text).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id] == gone["__gone"], "left_anti")
