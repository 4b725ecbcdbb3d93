"""Finding repeated windows of text units across a corpus; the common part of substring.py and suffixes.py.

A window is ``length`` consecutive units (words or bytes) of one text.  To mark every window whose content also starts
earlier, without moving every window through a shuffle:

1. Winnowing.  Of the ``gram``-unit grams in a window, the one with the least hash is the window's anchor.  It depends on
   the window's content alone, so equal windows have equal anchors at equal distances; about one unit in
   (length - gram) / 2 is an anchor.  Only anchors whose hash occurs twice in the corpus can belong to a repeated window.
   In each batch an anchor hash is sent once, with the number of its occurrences there; the others are known to repeat and
   skip the grouping, so a passage in a third of all documents loads no task.
2. Texts with repeated anchors are met with those (a join by document), and the windows of each such anchor are cut out
   as one stretch of text.  Of equal stretches of a batch (compared byte by byte) one is sent, the others are known to repeat.
3. Stretches meet by anchor hash, sorted, so a task holds the stretches of a few anchors at a time; a resolver compares
   their units and marks the windows that start earlier elsewhere.  Anchors with more than ``hot`` occurrences, counted
   exactly in step 1, would overload a task: their stretches are cut into pieces of ``units.piece`` windows, which meet by
   the content that these windows have in common.  A piece with many different contexts is so short that few differ.
4. Runs of marked windows go back to their documents.

Hashes only decide what meets; equality is decided on the units themselves.

Order: smaller id, then start.  A null id counts as the largest.  Rows that share an id are texts of their own, in an order
that is written down once (a table with row numbers, made only where ids repeat); of rows that share id and text all but one
are repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .textops import Chunk, byte_words, chunks, equal_runs, gram_hashes, inside, mix, ragged, sliding_min, word_hashes, words

#: An anchor with more occurrences than this is hot, at any size of the corpus.
HOT = 20_000
#: Up to so many hot anchors are sent to the tasks as a list; more are met by a join.
HOT_LIST = 1 << 20
#: Bytes of stretches among which equal ones are sent once.
SEND_BYTES = 16 << 20
#: Bytes of stretches that a resolver gets at once (whole keys, so at most HOT stretches more).
BLOCK_BYTES = 1 << 20

_LOW = np.uint64(0xFFFFFFFF)
_PLACE_BITS = 40


class Units:
    """What windows are made of."""

    #: Windows of a hot anchor that stay together.
    piece = 1

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram

    def hashes(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the gram at each unit, and the first unit of each row (with the end)."""
        raise NotImplementedError

    def bodies(self, c: Chunk, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Units start to end of the chunk."""
        raise NotImplementedError

    def edges(self, body: bytes) -> list[int] | range:
        """Byte offset of each unit of a body, and its end."""
        raise NotImplementedError

    def pieces(self, body: bytes, n: int, anchor: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(key, first window, windows, body) of the pieces of a stretch of n windows whose anchor is its unit ``anchor``.

        A piece has the windows whose distance from the anchor falls in one range; its key is the hash of what all windows
        of that range have in common, which lies in each of them.
        """
        edge = self.edges(body)
        for q in range(max(0, anchor - n + 1) // self.piece, anchor // self.piece + 1):
            last = anchor - q * self.piece
            first = last - self.piece + 1
            lo, hi = max(first, 0), min(last, n - 1)
            core = body[edge[last] : edge[first + self.length]]
            yield xxhash.xxh3_64_intdigest(core, q), lo, hi - lo + 1, body[edge[lo] : edge[hi + self.length]]


class Bytes(Units):
    piece = 4

    def hashes(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        n = max(0, len(c.data) - self.gram + 1)
        w = byte_words(c.data)
        h = np.zeros(n, np.uint64)
        for at in dict.fromkeys((*range(0, self.gram - 7, 8), self.gram - 8)):
            h = mix(h + w[at : at + n])
        return h, c.off

    def bodies(self, c: Chunk, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        line = c.data.tobytes()
        return [line[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]

    def edges(self, body: bytes) -> range:
        return range(len(body) + 1)


class Words(Units):
    """Bodies are words with one space after each."""

    def hashes(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        w = words(c)
        return gram_hashes(word_hashes(c, w), self.gram), w.first

    def bodies(self, c: Chunk, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        w = words(c)
        size = w.end - w.start + 1
        off = np.concatenate(([0], np.cumsum(size)))
        line = np.full(off[-1], 32, np.uint8)
        word, k = ragged(size - 1)
        line[off[word] + k] = c.data[w.start[word] + k]
        line = line.tobytes()
        return [line[a:b] for a, b in zip(off[start].tolist(), off[end].tolist(), strict=True)]

    def edges(self, body: bytes) -> list[int]:
        return [0, *(np.flatnonzero(np.frombuffer(body, np.uint8) == 32) + 1).tolist()]


def anchors(h: np.ndarray, first: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window, and its anchor: the leftmost gram whose hash has the least high half."""
    start = inside(first, units.length)
    if not len(start):
        return start, start
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    return start, (sliding_min(key, units.length - units.gram + 1)[start] & _LOW).astype(np.int64)


def numbered(docs: DataFrame, id: str, text: str, keep: list[str]) -> DataFrame:
    """rest (a struct of the columns to keep), doc (a unique number in the order of ids) and body (a null text is empty).

    The number is the id itself unless an id is null or repeats, which a count of the ids tells.
    """
    rows = docs.select(F.struct(*keep).alias("rest"), F.col(id).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    odd = docs.select(F.col(id).cast("long").alias("doc")).groupBy("doc").count().where("doc is null or count > 1").take(1)
    if not odd:
        return rows
    tie = F.xxhash64("body"), F.xxhash64(F.lit(1), "body"), F.monotonically_increasing_id()
    ordered = rows.select("*", *(t.alias(f"tie_{k}") for k, t in enumerate(tie))).sort(F.asc_nulls_last("doc"), "tie_0", "tie_1", "tie_2")
    # Partitions of the sort are in order, so these numbers are too; written, as a second run could give others.
    return written(ordered.select("rest", F.monotonically_increasing_id().alias("doc"), "body"), "rows")


def _batch_anchors(batch: pa.RecordBatch, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in its row of every anchor of a batch (doc, body)."""
    hs, rows, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in chunks(batch.column(1)):
        h, first = units.hashes(c)
        _, m = anchors(h, first, units)
        if len(m):
            m = m[np.append(True, m[1:] != m[:-1])]
            row = np.searchsorted(first, m, "right") - 1
            hs.append(h[m])
            rows.append(row + c.lo)
            places.append(m - first[row])
    return np.concatenate(hs), np.concatenate(rows), np.concatenate(places)


def repeated_anchors(docs: DataFrame, units: Units, hot: int = HOT) -> DataFrame:
    """A written table of doc and place of every anchor whose hash occurs more than once in the corpus; and in rows without doc the hashes (key) that occur more than ``hot`` times."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            h, row, place = _batch_anchors(batch, units)
            at, begin = equal_runs(h)
            n = np.ones(len(h), np.int64)
            n[at] = 0  # known to repeat; goes on without being grouped
            n[at[begin[:-1]]] = np.diff(begin)  # stands for all occurrences in this batch
            key = np.where(n == 0, mix(h ^ mix(doc[row].astype(np.uint64) + place.astype(np.uint64))), h)
            n = np.minimum(n, (1 << 22) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc[row]), pa.array(n << _PLACE_BITS | place)], names=["key", "doc", "at"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by key; the last key of a batch goes on in the next one: what is known of it is kept.
        last, met, total, waiting = None, 0, 0, None
        for batch in batches:
            key, doc, at = (batch.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            n, place = at >> _PLACE_BITS, at & ((1 << _PLACE_BITS) - 1)
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(begin, len(key)))
            sums = np.add.reduceat(n, begin)
            rows = size.copy()
            goes_on = key[0] == last
            if goes_on:
                rows[0] += met
                sums[0] += total
            many = np.repeat((rows > 1) | (sums != 1), size)
            hot_now = sums > hot
            hot_now[0] &= not (goes_on and total > hot)  # told already
            hot_keys = key[begin][hot_now]
            if goes_on and waiting is not None:  # the first row of this key had no partner so far
                doc, place, many = (np.append(a, b) for a, b in ((waiting[0], doc), (waiting[1], place), (True, many)))
            waiting = None
            last, met, total = key[-1], rows[-1], sums[-1]
            if met == 1 and total == 1:
                waiting = doc[-1], place[-1]
            yield out(doc[many], place[many], hot_keys)

    def out(doc: np.ndarray, place: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        none, blank = pa.nulls(len(keys), pa.int64()), pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(doc), none]), pa.concat_arrays([pa.array(place), none]), pa.concat_arrays([blank, pa.array(keys)])], names=["doc", "place", "key"])

    sent = docs.select("doc", "body").mapInArrow(send, "key long, doc long, at long")
    return written(sent.repartition("key").sortWithinPartitions("key").mapInArrow(group, "doc long, place long, key long"), "anchors")


#: body is null where a stretch is known to repeat.
_STRETCHES = "key long, doc long, at long, anchor int, n int, body binary"
_NAMES = ["key", "doc", "at", "anchor", "n", "body"]


def _sent_once(key: np.ndarray, doc: np.ndarray, at: np.ndarray, anchor: np.ndarray, n: np.ndarray, body: list[bytes]) -> pa.RecordBatch:
    """Of equal stretches the first in order keeps its body; runs of the others that follow one another become one row."""
    order = np.lexsort((at, doc))
    first: dict[bytes, int] = {}
    copy = np.fromiter((first.setdefault(body[i], i) != i for i in order.tolist()), bool, len(order))
    lead, known = order[~copy], order[copy]
    head = np.append(True, (doc[known][1:] != doc[known][:-1]) | (at[known][1:] != at[known][:-1] + n[known][:-1])) if len(known) else np.zeros(0, bool)
    begin = np.flatnonzero(head)
    run = np.add.reduceat(n[known], begin) if len(begin) else n[:0]
    known = known[begin]
    spread = mix(doc[known].astype(np.uint64) ^ mix(at[known].astype(np.uint64))).view(np.int64)
    rows = np.concatenate((lead, known))
    columns = np.concatenate((key[lead], spread)), doc[rows], at[rows], anchor[rows].astype(np.int32), np.concatenate((n[lead], run)).astype(np.int32)
    bodies = pa.array([body[i] for i in lead.tolist()] + [None] * len(known), pa.binary())
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), bodies], names=_NAMES)


def _in_pieces(parts: Iterator[tuple], units: Units) -> Iterator[tuple]:
    """key, doc, at, anchor, n and body of the pieces of hot stretches, which come as doc, at, anchor, n and body."""
    for doc, at, anchor, n, body in parts:
        for key, j, m, piece in units.pieces(body, n, anchor):
            yield key - (1 << 64 if key >> 63 else 0), doc, at + j, anchor - j, m, piece


def stretches(marked: DataFrame, units: Units, hot: np.ndarray | None) -> DataFrame:
    """Runs of windows of the same repeated anchor, from rows of doc, body and places; those of the hot anchors in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, places = batch.column(0).to_numpy(), batch.column(2)
            p_off, p_all = places.offsets.to_numpy(), places.values.to_numpy()
            held: list[tuple] = []
            size = 0
            for c in chunks(batch.column(1)):
                h, first = units.hashes(c)
                start, m = anchors(h, first, units)
                here = p_all[p_off[c.lo] : p_off[c.hi]] + np.repeat(first[:-1], np.diff(p_off[c.lo : c.hi + 1]))
                mark = np.zeros(len(h) + 1, bool)
                mark[here] = True
                start, m = start[mark[m]], m[mark[m]]
                if not len(start):
                    continue
                begin = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (start[1:] != start[:-1] + 1)))
                n = np.diff(np.append(begin, len(start)))
                start, m = start[begin], m[begin]
                row = np.searchsorted(first, start, "right") - 1
                body = units.bodies(c, start, start + n + units.length - 1)
                found = [h[m].view(np.int64), doc[c.lo + row], start - first[row], m - start, n, body]
                if hot is not None and (warm := np.isin(found[0], hot)).any():
                    parts = zip(*(x[warm].tolist() for x in found[1:5]), [body[i] for i in np.flatnonzero(warm).tolist()], strict=True)
                    cut = list(_in_pieces(parts, units))
                    found = [np.concatenate((x[~warm], np.array([p[k] for p in cut], np.int64))) for k, x in enumerate(found[:5])]
                    found.append([body[i] for i in np.flatnonzero(~warm).tolist()] + [p[5] for p in cut])
                held.append(tuple(found))
                size += sum(map(len, found[5])) + 80 * len(found[5])
                if size >= SEND_BYTES:
                    yield flush(held)
                    size = 0
            if held:
                yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        *arrays, bodies = zip(*held, strict=True)
        held.clear()
        return _sent_once(*map(np.concatenate, arrays), [b for part in bodies for b in part])

    # rest isn't used here, but with it the texts' exchange is the one that the last join reads, and Spark reuses it.
    return marked.select("doc", "body", "places", "rest").mapInArrow(run, _STRETCHES)


def split_hot(found: DataFrame, hot: DataFrame, units: Units) -> DataFrame:
    """Stretches with those of the hot keys (a table of any size) cut into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            warm = np.array(pa.compute.and_(batch.column(6).is_valid(), batch.column(5).is_valid()))
            yield batch.filter(pa.array(~warm)).select(_NAMES)
            some = batch.filter(pa.array(warm))
            if cut := list(_in_pieces(zip(*(some.column(k).to_pylist() for k in (1, 2, 3, 4, 5)), strict=True), units)):
                yield _sent_once(*(np.array([p[k] for p in cut], np.int64) for k in range(5)), [p[5] for p in cut])

    return found.join(hot.select("key", F.lit(True).alias("hot")), "key", "left").select(*_NAMES, "hot").mapInArrow(run, _STRETCHES)


@dataclass
class Block:
    """Stretches of some keys in order of document and start; stretch i has n[i] windows, its anchor at unit anchor[i]."""

    key: np.ndarray
    anchor: np.ndarray
    n: np.ndarray
    data: np.ndarray
    off: np.ndarray


Resolver = Callable[[Block], np.ndarray]


def repeated_runs(found: DataFrame, length: int, resolve: Resolver) -> DataFrame:
    """doc, begin, end: unit ranges that repeated windows cover (they may overlap)."""

    def spans(doc: np.ndarray, begin: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(begin), pa.array(begin + n + length - 1)], names=["doc", "begin", "end"])

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of whole keys, sorted by key."""
        rows = [pa.concat_arrays([b.column(i) for b in held]) for i in range(6)]
        key, doc, at, anchor, n = (c.to_numpy() for c in rows[:5])
        n = n.astype(np.int64)
        known = np.array(rows[5].is_null())
        if known.any():
            yield spans(doc[known], at[known], n[known])
        same = key[1:] == key[:-1]
        meets = (np.append(False, same) | np.append(same, False)) & ~known  # a stretch alone in its key repeats nothing
        work = np.flatnonzero(meets)
        if len(work) < 2:
            return
        work = work[np.lexsort((at[work], doc[work]))]
        body = rows[5].take(pa.array(work))
        off = np.frombuffer(body.buffers()[1], np.int32)[: len(work) + 1].astype(np.int64)
        data = np.frombuffer(body.buffers()[2], np.uint8)[: off[-1]]
        n = n[work]
        dup = resolve(Block(key[work], anchor[work].astype(np.int64), n, data, off))
        owner, j = ragged(n)
        new = owner[1:] != owner[:-1]
        b = np.flatnonzero(dup & np.append(True, ~dup[:-1] | new))
        e = np.flatnonzero(dup & np.append(~dup[1:] | new, True))
        if len(b):
            yield spans(doc[work][owner[b]], at[work][owner[b]] + j[b], e - b + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(key[0] != last if held else False, key[1:] != key[:-1]))
            last = key[-1]
            total = np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(5)), 0).to_numpy() + 48)))
            lo = 0
            for e in edges.tolist():  # only places where a block may end
                if size + total[e] - total[lo] >= BLOCK_BYTES:
                    held.append(batch.slice(lo, e - lo))
                    yield from settle(held)
                    held, size, lo = [], 0, e
            held.append(batch.slice(lo))
            size += int(total[-1] - total[lo])
        if held:
            yield from settle(held)

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc long, begin long, end long")


def with_repeats(docs: DataFrame, units: Units, resolve: Resolver, id: str = "doc_id", text: str = "text", hot: int = HOT, keep: list[str] | None = None) -> DataFrame:
    """rest (a struct of the columns to keep, by default the id), body and begins, ends: the unit ranges of the text that repeated windows cover."""
    texts = numbered(docs, id, text, [id] if keep is None else keep)
    found = repeated_anchors(texts, units, hot)
    places = found.where("doc is not null").groupBy("doc").agg(F.collect_list("place").alias("places"))  # no longer than the text
    hot_keys = found.where("doc is null").select("key")
    # Both joins deal the texts out by the same key, so Spark moves them once and reads the exchange twice.
    marked = texts.join(places, "doc")
    if hot_keys.count() <= HOT_LIST:
        few = hot_keys.toArrow()["key"].to_numpy()
        cut = stretches(marked, units, few if len(few) else None)
    else:
        cut = split_hot(stretches(marked, units, None), hot_keys, units)
    runs = repeated_runs(cut, units.length, resolve).groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    return texts.join(runs, "doc", "left").select("rest", "body", F.col("runs.begin").alias("begins"), F.col("runs.end").alias("ends"))


def covered_units(batch: pa.RecordBatch, c: Chunk, first: np.ndarray, begins: int, ends: int) -> np.ndarray:
    """Mask of a chunk's units that the ranges in two list columns cover; first: the first unit of each row."""
    total = int(first[-1])
    lists = batch.column(begins).slice(c.lo, c.n), batch.column(ends).slice(c.lo, c.n)
    count = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists[0]), 0))
    base = np.repeat(first[:-1], count)
    opened, closed = (np.bincount(base + x.flatten().to_numpy(), minlength=total + 1)[:total] for x in lists)
    return np.cumsum(opened - closed) > 0
