"""Repeats inside sequences, for all sequences of an Arrow batch at once.

Windows of 2**j items get numbers in the order of their content (numbers of pairs of windows half as long), for all sequences together but
never equal between two of them.  A window of any size is then the pair of two such windows that cover it, so windows of a size
of each sequence's own are compared by one sort.  Sizes are found by halving, for all sequences side by side: if a size repeats, so
does every smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items worked on at once in a task; one longer sequence is taken whole.
STEP = 1 << 17


class Windows:
    """Order-preserving numbers of the windows of sequences; sequence i has the items from off[i] to off[i + 1]."""

    def __init__(self, items: np.ndarray, off: np.ndarray):
        self.off, self.size = off, np.diff(off)
        self.seq = np.repeat(np.arange(len(self.size)), self.size)
        self.end = off[1:][self.seq]
        _, rank = np.unique(items, return_inverse=True)
        _, rank = np.unique(self.seq * (len(items) + 1) + rank, return_inverse=True)
        self.levels = [rank.astype(np.int64)]
        width, most = 1, int(self.size.max(initial=0))
        while 2 * width <= most:
            last = self.levels[-1]
            at = np.flatnonzero(np.arange(len(items)) + 2 * width <= self.end)
            out = np.full(len(items), -1, np.int64)
            _, out[at] = np.unique(last[at] * (len(items) + 1) + last[at + width], return_inverse=True)
            self.levels.append(out)
            width *= 2

    def numbers(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A number for the window of a size (at least 1) at each place; equal and ordered as the windows, for windows of one size."""
        level = np.frexp(size.astype(float))[1] - 1
        out = np.empty(len(at), np.int64)
        for j in np.unique(level):
            own = np.flatnonzero(level == j)
            rank = self.levels[j]
            span = len(rank) + 1
            out[own] = (int(j) * span + rank[at[own]]) * span + rank[at[own] + size[own] - (1 << int(j))]
        return out

    def places(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place where a window of its sequence's size begins (sequences of size 0 have none), and its sequence."""
        at = np.flatnonzero((size[self.seq] > 0) & (np.arange(len(self.seq)) + size[self.seq] <= self.end))
        return at, self.seq[at]


def _largest(most: np.ndarray, holds) -> np.ndarray:
    """For each sequence the largest size from 0 to most for which ``holds`` (a mask by sequence), where smaller sizes hold too."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    while (go := low < high).any():
        size = np.where(go, (low + high + 1) // 2, 0)
        good = holds(size)
        low, high = np.where(go & good, size, low), np.where(go & ~good, size - 1, high)
    return low


def longest_repeats(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Start (in the sequence) and length of the longest sublist that occurs again after its end; of several the one that begins first."""

    def first_repeats(size: np.ndarray) -> np.ndarray:
        """The least place of a window that occurs again after its end, by sequence; the number of items if none does."""
        at, seq = w.places(size)
        _, lead, group = np.unique(w.numbers(at, size[seq]), return_index=True, return_inverse=True)
        lead = at[lead][group]
        again = np.flatnonzero(at - lead >= size[seq])
        out = np.full(len(size), len(w.seq), np.int64)
        np.minimum.at(out, seq[again], lead[again])
        return out

    n = len(w.seq)
    size = _largest(w.size // 2, lambda s: first_repeats(s) < n)
    start = np.where(size > 0, first_repeats(size) - w.off[:-1], 0)
    return start, size


def _counts(w: Windows, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of windows of each sequence's size: place, sequence, number, and how often it occurs without overlap, taken from the left, from here on."""
    at, seq = w.places(size)
    number = w.numbers(at, size[seq])
    _, number = np.unique(number, return_inverse=True)
    order = np.lexsort((at, number))
    at, seq, number = at[order], seq[order], number[order]
    span = len(w.seq) + 1
    key = number * span + at
    # The next occurrence after this one's end, as a place in the order; the last place stands for none.
    after = np.searchsorted(key, key + size[seq])
    n = len(at)
    none = (after >= n) | (number[np.minimum(after, n - 1)] != number) if n else np.zeros(0, bool)
    jump = np.append(np.where(none, n, after), n)
    count = np.append(np.ones(n, np.int64), 0)
    while (jump[:n] < n).any():
        count = count + count[jump]
        jump = jump[jump]
    return at, seq, number, count[:n]


def most_frequent(w: Windows, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the sublist of at least ``least`` items that occurs most often without overlap (ties: the longest, then the first in order).

    Sequences in which nothing occurs twice are their own; shorter ones than ``least`` have length 0.  No sublist occurs more often than a part of it, so
    the sizes at which the highest count is reached are all from ``least`` to some length.
    """
    long = w.size >= least

    def highest(size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(size), np.int64)
        _, seq, _, count = _counts(w, size)
        np.maximum.at(out, seq, count)
        return out

    most = highest(np.where(long, least, 0))
    more = np.where(most > 1, w.size - least, 0)
    size = least + _largest(more, lambda s: highest(np.where(s > 0, least + s, 0)) == most)
    size = np.where(most > 1, size, np.where(long, w.size, 0))
    at, seq, number, count = _counts(w, size)
    start = np.zeros(len(size), np.int64)
    good = np.flatnonzero(count == most[seq])
    order = np.lexsort((at[good], number[good], seq[good]))
    good = good[order]
    head = np.flatnonzero(np.append(True, np.diff(seq[good]) != 0)) if len(good) else good
    start[seq[good[head]]] = at[good[head]] - w.off[seq[good[head]]]
    return start, size


def repeated_chunks(w: Windows, least: int = 2, most: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Size and k of the least k in range for which a sequence is k copies of a chunk and a beginning of it; (0, -1) if none.

    That is the largest period of at most 1 / least of the sequence that fits it at least ``least`` and at most ``most`` times.
    """
    smallest = w.size // (most + 1) + 1
    number = np.maximum(w.size // least - smallest + 1, 0)
    seq = np.repeat(np.arange(len(number)), number)
    period = smallest[seq] + np.arange(len(seq)) - np.repeat(np.cumsum(number) - number, number)
    rest = w.size[seq] - period
    fits = np.flatnonzero(w.numbers(w.off[seq], rest) == w.numbers(w.off[seq] + period, rest))
    size = np.zeros(len(number), np.int64)
    np.maximum.at(size, seq[fits], period[fits])
    return size, np.where(size > 0, w.size // np.maximum(size, 1), -1)


def _runs(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of sequences of about STEP items."""
    lo = 0
    while lo < len(off) - 1:
        hi = min(len(off) - 1, max(lo + 1, int(np.searchsorted(off, off[lo] + STEP, "right")) - 1))
        yield lo, hi
        lo = hi


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, offsets and nulls of a list column; a null item is an item of its own."""
    nulls = column.is_null().to_numpy(False)
    column = column.fill_null([]) if nulls.any() else column
    off = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.int64()).slice(off[0], off[-1] - off[0])
    return values.fill_null(np.iinfo(np.int64).min).to_numpy(), off - off[0], nulls


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, offsets and nulls of a text column."""
    nulls = column.is_null().to_numpy(False)
    texts = column.fill_null("").to_pylist()
    off = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), off, nulls


def _found(items: np.ndarray, off: np.ndarray, find) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each sequence, from runs of them."""
    got = [find(Windows(items[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])) for lo, hi in _runs(off)]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 2


def _sublists(items: np.ndarray, off: np.ndarray, start: np.ndarray, size: np.ndarray, nulls: np.ndarray) -> pa.Array:
    at = np.repeat(off[:-1] + start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    edge = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    values = pa.array(items[at]) if not len(items) or items.min() > np.iinfo(np.int64).min else pa.array(items[at], mask=items[at] == np.iinfo(np.int64).min)
    return pa.ListArray.from_arrays(pa.array(edge, mask=np.append(nulls, False)), values.cast(pa.int32()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def repeated_sublist(tokens: pa.Array) -> pa.Array:
    """longest_repeats() of a column of token lists; null for null."""
    items, off, nulls = _lists(tokens)
    return _sublists(items, off, *_found(items, off, longest_repeats), nulls)


@F.arrow_udf(T.StructType([T.StructField("chunk", T.ArrayType(T.IntegerType())), T.StructField("k", T.IntegerType())]))
def chunk(tokens: pa.Array) -> pa.Array:
    """repeated_chunks() of a column of token lists; null for null."""
    items, off, nulls = _lists(tokens)
    size, k = _found(items, off, repeated_chunks)
    lists = _sublists(items, off, np.zeros(len(size), np.int64), size, np.zeros(len(size), bool))
    return pa.StructArray.from_arrays([lists, pa.array(k.astype(np.int32))], names=["chunk", "k"], mask=pa.array(nulls))


@F.arrow_udf(T.StringType())
def frequent_substring(text: pa.Array) -> pa.Array:
    """most_frequent() of the characters of a text column; null for null, and for texts of fewer than two characters."""
    items, off, nulls = _characters(text)
    start, size = _found(items, off, most_frequent)
    texts = text.to_pylist()
    return pa.array([None if none or not n else t[a : a + n] for t, none, a, n in zip(texts, nulls, start.tolist(), size.tolist(), strict=True)], pa.string())
