"""Suffix-array dedup by difference-cover blockwise construction.

repeats.py brings together the stretches of text whose windows can repeat; here a block of them is sorted:

* A difference cover D modulo V is a set of residues such that any two places are both in D after one shift of less than V.
  The suffixes at the places of the block that lie in D are ranked first (the cover sample, under a fifth of all places):
  by their first V bytes, and then by doubling, as the place V further on is in the sample too.
* The windows' suffixes are then sorted one suffix bucket at a time (by their first bytes), to V bytes directly.  Suffixes
  that still tie are settled by the sample's ranks after their shift, in a three-way quicksort that treats all ties of the
  bucket at once.  So a tie of any length costs one look-up, and memory is bounded by the sample and one bucket.
* Neighbours in the sorted bucket whose common prefix has the window's length are occurrences of the same string; all but
  the first in document order are repeats.

Hashes only bring stretches together; what repeats is decided by comparing bytes.  Stretches that are equal as a whole
within one batch are compared there, before they are sent, and only one of them is sorted.

Defined cases: a null text is empty; matches never cross documents; null and repeated ids are ordered as repeats.py says, and
of rows that share id and text all but one are repeats; an empty table gives an empty result; columns other than id and text are ignored by ``remove_repeats``.
``deduplicate`` keeps all columns, whatever their names; a character that lost some of its bytes goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import HOT, Block, Bytes, covered_units, with_repeats
from .textops import byte_words, chunks, ragged

LENGTH, SEED = 100, 24
#: A perfect difference set: every residue modulo 31 is a difference of two of its members in one way.
V, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Suffixes in a bucket, about.
BUCKET = 1 << 16


def _shifts() -> np.ndarray:
    """shift[a, b] < V brings places of residues a and b both into the cover."""
    cover = set(COVER)
    return np.array([[next(k for k in range(V) if (a + k) % V in cover and (b + k) % V in cover) for b in range(V)] for a in range(V)])


SHIFT = _shifts()


def _refine(at: np.ndarray, keys: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of some places by one key after the other (each an array over all places), and the number of each one's group of equals."""
    n = len(at)
    order, group = np.arange(n), np.zeros(n, np.int64)
    tied = np.arange(n)  # positions in order that are not alone in their group
    for key in keys:
        if not len(tied):
            break
        w = key[at[order[tied]]]
        if len(tied) == n and not group[-1]:  # one group so far
            by = np.argsort(w)
        else:
            by = np.lexsort((w, group[tied]))
        order[tied] = order[tied][by]
        w, g = w[by], group[tied]
        # A group's number is the position of its first member, so parts of a group get new numbers in place.
        new = np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]))
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(tied)))
        group[tied] = np.repeat(tied[head], size)
        tied = tied[np.repeat(size > 1, size)]
    return order, group


def _prefix_keys(word: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """The first depth bytes at each place as integers of 8 bytes; word: the 8 bytes at each place."""
    for d in range(0, depth, 8):
        w = word[d:]
        yield w if depth - d >= 8 else w >> np.uint64(8 * (8 - depth + d))


def _cover_ranks(word: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes at the cover's places among n, by at least depth bytes; 0 elsewhere."""
    sample = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
    order, group = _refine(sample, _prefix_keys(word, V))
    rank, known = np.zeros(len(word), np.int64), V
    rank[sample[order]] = group + 1
    while known < depth and len(sample):
        order, group = _refine(sample, iter((rank, np.append(rank[known:], np.zeros(known, np.int64)))))
        rank[sample[order]] = group + 1
        known *= 2
    return rank


def _settle(order: np.ndarray, group: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sorts each group of ties by the cover sample's ranks: three-way quicksort of all groups at once."""
    alone = np.append(True, group[1:] != group[:-1]) & np.append(group[1:] != group[:-1], True)
    tied = np.flatnonzero(~alone)
    part = group[tied]
    while len(tied):
        head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        size = np.diff(np.append(head, len(tied)))
        own = np.repeat(np.arange(len(head)), size)
        me = at[order[tied]]
        pivot = me[head + size // 2][own]
        k = SHIFT[me % V, pivot % V]
        sign = np.sign(rank[me + k] - rank[pivot + k])
        by = np.argsort(own * 3 + sign + 1, kind="stable")
        order[tied] = order[tied][by]
        part = (own * 3 + sign + 1)[by]
        go = sign[by] != 0
        size = np.bincount(part)[part]
        tied, part = tied[go & (size > 1)], part[go & (size > 1)]
    return order


def _buckets(word: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of the suffixes, one bucket at a time; suffixes that share their first 8 bytes share their bucket."""
    first = word[at]
    many = len(at) // BUCKET
    if not many:
        yield np.arange(len(at))
        return
    step = max(1, len(first) // (many * 64))
    splitters = np.unique(np.sort(first[::step])[:: 64])
    bucket = np.searchsorted(splitters, first, "right")
    for b in np.unique(bucket):
        yield np.flatnonzero(bucket == b)


def resolver(length: int = LENGTH):
    """Marks the windows of a block that start earlier in it too."""

    def resolve(b: Block) -> np.ndarray:
        word = byte_words(np.append(b.data, np.zeros(2 * length + 2 * V, np.uint8)))
        stretch, j = ragged(b.n)
        at = b.off[:-1][stretch] + j  # in document order, as the stretches are
        rank = _cover_ranks(word, len(b.data), length)
        dup = np.zeros(len(at), bool)
        for mine in _buckets(word, at):
            order, group = _refine(at[mine], _prefix_keys(word, V))
            order = mine[_settle(order, group, at[mine], rank)]
            same = np.append(False, group[1:] == group[:-1])
            near = np.flatnonzero(same)
            p, q = at[order[near]], at[order[near - 1]]
            equal = np.ones(len(near), bool)
            for d in range(V - V % 8, length, 8):
                left = np.flatnonzero(equal)
                if not len(left):
                    break
                u, v = word[p[left] + d], word[q[left] + d]
                if length - d < 8:
                    u, v = u >> np.uint64(8 * (8 - length + d)), v >> np.uint64(8 * (8 - length + d))
                equal[left[u != v]] = False
            same[near[~equal]] = False
            head = np.flatnonzero(~same)
            lead = np.repeat(np.minimum.reduceat(order, head), np.diff(np.append(head, len(order))))
            dup[order] = order != lead
        return dup

    return resolve


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                gone = covered_units(batch, c, c.off, 2, 3)
                runs = gone.copy()
                heads = c.off[:-1][c.off[:-1] < c.off[1:]]
                runs[1:] &= ~gone[:-1]
                runs[heads] = gone[heads]
                sums = [np.concatenate(([0], np.cumsum(m))) for m in (gone, runs)]
                removed, spans = (s[c.off[1:]] - s[c.off[:-1]] for s in sums)
                size = np.diff(c.off)
                off = np.concatenate(([0], np.cumsum(size - removed)))
                kept = pa.Array.from_buffers(pa.large_binary(), c.n, [None, pa.py_buffer(off), pa.py_buffer(c.data[~gone])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), *map(pa.array, (size, removed, spans)), kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    found = with_repeats(docs, Bytes(length, seed), resolver(length), id, text, hot).select(F.col("rest")[id].cast("long").alias("doc_id"), "body", "begins", "ends")
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", chars: str = "n_chars", length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """docs with what is left of each text (a null one is then empty); the column chars, if there is one, follows the text."""
    others = [c for c in docs.columns if c != text]
    found = with_repeats(docs, Bytes(length, seed), resolver(length), id, text, hot, others)
    schema = T.StructType([found.schema["rest"], T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                gone = covered_units(batch, c, c.off, 2, 3)
                kept = [c.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(c.off[:-1], c.off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(kept, pa.string())], names=["rest", "kept"])

    left = found.mapInArrow(run, schema)
    column = {c: F.col("rest")[c] for c in others} | {text: F.col("kept")}
    if chars in column:
        column[chars] = F.length("kept").cast(docs.schema[chars].dataType)
    return left.select(*(column[c].alias(c) for c in docs.columns))
