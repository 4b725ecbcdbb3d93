"""Periodic runs of words by grammar compression.

A run is a maximal stretch of at least 4 smallest periods and 6 words.  For the texts of a chunk at once:

1. Words become numbers, of their own in each text.  Every three words of a run occur three times in its text, so words of
   which that isn't true belong to no run; what is left falls into stretches, which are all that follows.
2. Re-Pair: a pair of neighbouring symbols that occurs twice or more becomes a nonterminal.  A round replaces, wherever pairs
   overlap, the one that occurs more often (ties by a hash), for all texts together, and rounds go on until no pair occurs
   twice.  Each nonterminal keeps the places it was made at; these are all its places in the derivation.
3. A run lies across a boundary of the smallest symbol that holds it, so it is found there: for each nonterminal once, at its first
   place, between its two parts, and between neighbours of what is left of the stretch.  A period p of 2**j to 2**(j+1) - 1 words
   repeats the 2**j words right or left of the boundary p words on; the places of equal 2**j words come from numbers of such
   grams, by doubling.  Both ends are then compared with the words p before and after, as far as the symbol goes.
4. A nonterminal's runs are moved to all its places; intervals of one period that overlap by a period are one, and of equal intervals
   the smallest period stays.

Symbols, grams and comparisons are numbers of words (confirmed by bytes), so nothing rests on a hash.  The work on a text without long repeats
ends after the first step; no pair of places is tried that doesn't share a gram as long as half its period.

Defined cases: a null text, or one without words, has no runs and the hash of an empty list; a null id is a row as any other
(``splice`` leaves its words alone); rows that share an id are texts of their own; a very long text is a chunk of its own, so its
words are in one task's memory (about 200 bytes a word while they are numbered); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Chunk, Words, chunks, mix, ragged, range_hash, same_bytes, words

#: Periods and words that a run has at least.
PERIODS, LEAST = 4, 6


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values in their order, and how often each place's value occurs."""
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    return number, count[number]


def word_numbers(c: Chunk, w: Words) -> np.ndarray:
    """Equal numbers for equal words of the chunk; words are compared, so a shared hash doesn't make them equal."""
    left = np.arange(len(w.start))
    out = np.zeros(len(left), np.int64)
    h = range_hash(c.data, w.start, w.end)
    base = 0
    while len(left):
        _, lead, number = np.unique(h[left], return_index=True, return_inverse=True)
        lead = left[lead][number]
        same = same_bytes(c.data, w.start[left], w.end[left], w.start[lead], w.end[lead])
        out[left[same]] = base + number[same]
        base += len(left)
        left = left[~same]
    return out


def live_stretches(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, numbers (of their own in each text) and stretches of the words that can be in a run."""
    n = len(word)
    symbol, times = _dense(row * (int(word.max()) + 1) + word) if n else (word, word)
    # A run holds each of its words four times, and each of its triples three times.
    fit = times >= 4
    at = np.flatnonzero(fit[:-2] & fit[1:-1] & fit[2:] & (row[:-2] == row[2:])) if n > 2 else np.zeros(0, np.int64)
    pair, _ = _dense(symbol[at] * n + symbol[at + 1])
    _, times = _dense(pair * n + symbol[at + 2])
    at = at[times >= 3]
    # Triples that lie side by side are a stretch; it has the words of all of them.
    new = np.append(True, np.diff(at) != 1)[: len(at)]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at))) + 2
    keep = size >= LEAST
    stretch, k = ragged(size[keep])
    place = at[head[keep]][stretch] + k
    return place, symbol[place], stretch


def grammar(symbol: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of the stretches: begin, middle, end and rule of every place where a rule was made, and where the last sequence's symbols begin.

    The first place of each rule comes first among its places.
    """
    begin, end = np.arange(len(symbol)), np.arange(1, len(symbol) + 1)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    rules, next_symbol = 0, int(symbol.max(initial=0)) + 1
    of = stretch.copy()
    while True:
        i = np.flatnonzero(of[:-1] == of[1:])
        _, first, pair = np.unique(symbol[i] * next_symbol + symbol[i + 1], return_index=True, return_inverse=True)
        # Of a chain of one pair (aaaa) every other place counts, from the left.
        head = np.append(True, (i[1:] != i[:-1] + 1) | (pair[1:] != pair[:-1]))[: len(i)]
        odd = (np.arange(len(i)) - np.flatnonzero(head)[np.cumsum(head) - 1]) % 2 == 1
        count = np.bincount(pair[~odd], minlength=len(first))
        order = np.lexsort((mix(first.astype(np.uint64)), count))
        rank = np.zeros(len(first), np.int64)
        rank[order] = np.arange(1, len(first) + 1)
        rank[count < 2] = 0
        at_place = np.zeros(len(symbol) + 2, np.int64)
        at_place[i + 1] = rank[pair]
        # Of pairs that overlap the higher rank wins; the highest of all wins everywhere, so each round gets on.
        picked = np.flatnonzero(~odd & (rank[pair] > 0) & (rank[pair] >= at_place[i]) & (rank[pair] >= at_place[i + 2]))
        _, times = _dense(pair[picked])
        picked = picked[times > 1]
        if not len(picked):
            break
        rule, first = np.unique(pair[picked], return_inverse=True)
        at = i[picked]
        made.append((begin[at], end[at], end[at + 1], rules + first))
        symbol, end = symbol.copy(), end.copy()
        symbol[at] = next_symbol + first
        end[at] = end[at + 1]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, begin, end, of = symbol[keep], begin[keep], end[keep], of[keep]
        # Numbers stay small: those in use, in order.
        symbol, _ = _dense(symbol)
        next_symbol = int(symbol.max()) + 1
        rules += len(rule)
    lo, middle, hi, rule = (np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.int64) for k in range(4))
    return lo, middle, hi, rule, begin


def _reach(symbol: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from a and b on (step 1) or before them (step -1) are equal, up to ``most``; looked at in growing pieces."""
    out, go, size = np.zeros(len(a), np.int64), np.arange(len(a)), 4
    while len(go):
        n = np.minimum(size, most[go] - out[go])
        i, k = ragged(n)
        k = (out[go][i] + k) * step - (step < 0)
        differs = symbol[a[go][i] + k] != symbol[b[go][i] + k]
        first = n.copy()
        bad = np.flatnonzero(differs)[::-1]
        first[i[bad]] = bad - (np.cumsum(n) - n)[i[bad]]
        out[go] += first
        go = go[(first == n) & (out[go] < most[go])]
        size *= 4
    return out


def boundary_runs(symbol: np.ndarray, stretch: np.ndarray, lo: np.ndarray, middle: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boundary, start, end and period of the repetitions of at least PERIODS periods across each boundary (middle), within lo to hi."""
    n = len(symbol)
    gram, place = symbol, np.arange(n)  # numbers of the grams of 2**j words, where one occurs more than once
    end_of = np.append(np.flatnonzero(stretch[1:] != stretch[:-1]) + 1, n)[stretch] if n else stretch
    found = []
    width = 1
    longest = int((hi - lo).max(initial=0))
    reach = {1: np.zeros(len(lo), np.int64), -1: np.zeros(len(lo), np.int64)}  # of what a smaller period covers on either side
    while PERIODS * width <= longest and len(place):
        key = gram * (n + 1) + place
        key.sort()
        at_place = np.full(n + 1, -1, np.int64)
        at_place[place] = gram
        for side in (1, -1):
            # The gram right of the boundary again p words on, or the gram left of it p words before.
            x, room = (middle, hi - middle) if side > 0 else (middle - width, middle - lo)
            b = np.flatnonzero((hi - lo >= PERIODS * width) & (room >= 2 * width))
            b = b[at_place[x[b]] >= 0]
            # A gram that lies within what a smaller period covers gives no period of its own.
            least = np.maximum(width, reach[side][b] - width + 1)
            most = np.minimum(np.minimum(2 * width - 1, room[b] // 2), (hi[b] - lo[b]) // PERIODS)
            b, least, most = (y[least <= most] for y in (b, least, most))
            x, base = x[b], at_place[x[b]] * (n + 1)
            from_, to = (np.searchsorted(key, base + x + least), np.searchsorted(key, base + x + most, "right")) if side > 0 else (np.searchsorted(key, base + x - most), np.searchsorted(key, base + x - least, "right"))
            k, j = ragged(np.maximum(to - from_, 0))
            p = np.abs(key[from_[k] + j] % (n + 1) - x[k])
            b = b[k]
            # Two periods side by side: their other ends agree too, and a gram at each end covers a period.
            far = (middle[b] + p - width, middle[b] + 2 * p - width) if side > 0 else (middle[b] - p, middle[b] - 2 * p)
            square = (at_place[far[0]] == at_place[far[1]]) & (at_place[far[0]] >= 0)
            b, p = b[square], p[square]
            m = middle[b]
            if side > 0:
                right, left = _reach(symbol, m, m + p, hi[b] - m - p, 1) + p, _reach(symbol, m, m + p, m - lo[b], -1)
            else:
                right, left = _reach(symbol, m, m - p, hi[b] - m, 1), _reach(symbol, m, m - p, m - p - lo[b], -1) + p
            np.maximum.at(reach[side], b, right if side > 0 else left)
            good = left + right >= np.maximum(PERIODS * p, LEAST)
            found.append((b[good], m[good] - left[good], m[good] + right[good], p[good]))
        # Grams of twice the width: two that lie side by side in one stretch and occur more than once.
        place = place[place + 2 * width <= end_of[place]]
        place = place[at_place[place + width] >= 0]
        gram, times = _dense(at_place[place] * (n + 1) + at_place[place + width])
        place, gram = place[times > 1], gram[times > 1]
        width *= 2
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that overlap by a period become one; of equal intervals the smallest period stays.  In order of start and period."""
    order = np.lexsort((start, period, stretch[start])) if len(start) else np.zeros(0, np.int64)
    start, end, period, of = start[order], end[order], period[order], stretch[start[order]] if len(order) else start
    if not len(start):
        return start, end, period
    # Ends so far, within a stretch and a period: both are made part of the value that is accumulated.
    new = np.append(True, (of[1:] != of[:-1]) | (period[1:] != period[:-1]))
    group = np.cumsum(new)
    size = int(end.max()) + 1
    reach = np.maximum.accumulate(group * size + end) - group * size
    new[1:] |= start[1:] + period[1:] > reach[:-1]
    head = np.flatnonzero(new)
    start, end, period = start[head], np.maximum.reduceat(end, head), period[head]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    once = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))
    start, end, period = start[once], end[once], period[once]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find_runs(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, and smallest period of every run, in order of start and period; rows must be in order."""
    place, symbol, stretch = live_stretches(word, row)
    if not len(place):
        return place, place, place
    lo, middle, hi, rule, left = grammar(symbol, stretch)
    # Each rule at its first place, and the boundaries of what is left of each stretch.
    _, once = np.unique(rule, return_index=True)
    inner = left[1:][stretch[left[1:]] == stretch[left[:-1]]]
    edge = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
    bounds = np.append(edge, len(stretch))
    of = stretch[inner]
    at, start, end, period = boundary_runs(symbol, stretch, np.append(lo[once], bounds[of]), np.append(middle[once], inner), np.append(hi[once], bounds[of + 1]))
    # Runs of rules go to all places of the rule.
    top = at >= len(once)
    order = np.argsort(rule, kind="stable")
    count = np.bincount(rule, minlength=len(once))
    first = np.cumsum(count) - count
    k, j = ragged(count[at[~top]])
    move = lo[order[first[at[~top]][k] + j]] - lo[once][at[~top]][k]
    start, end, period = (np.append(x[top], x[~top][k] + m) for x, m in ((start, move), (end, move), (period, 0)))
    start, end, period = merged(start, end, period, stretch)
    return place[start], place[end - 1] + 1, period


Source = Callable[[pa.Array, Words], np.ndarray]


def splice(ids: pa.Array, w: Words) -> np.ndarray:
    """For each word of the texts the word that takes its place: a tenth of the ids repeat a part of their text to the end."""
    out = np.arange(len(w.start))
    for k, i in enumerate(ids.to_pylist()):
        n = int(w.first[k + 1] - w.first[k])
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 or not n:
            continue
        a, p = h // 10 % n, 0
        p = 1 + (n - a) // (3 + h // 10 % 8)
        out[w.first[k] + a : w.first[k + 1]] = w.first[k] + a + np.arange(n - a) % p
    return out


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text", source: Source | None = None) -> DataFrame:
    """doc_id, runs (start, length and period of each, in order of start and period) and collapsed (the words outside the repeats of any run).

    ``source`` may put other words of a text in the place of its words.
    """
    return _analysed(docs, id, text, source, False)


def run_digests(docs: DataFrame, id: str = "doc_id", text: str = "text", source: Source | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and SHA-256 of the list of runs and of the collapsed words."""
    return _analysed(docs, id, text, source, True)


_LISTED = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _collapsed(c: Chunk, w: Words, take: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that stay, joined by one space: bytes of all texts, and their offsets."""
    keep = np.flatnonzero(~gone)
    word, row = take[keep], w.row[keep]
    size = w.end[word] - w.start[word] + 1
    end = np.cumsum(size)
    out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
    i, k = ragged(size - 1)
    out[(end - size)[i] + k] = c.data[w.start[word][i] + k]
    edge = np.searchsorted(row, np.arange(c.n + 1))
    return out, np.append(0, end)[edge]


def _analysed(docs: DataFrame, id: str, text: str, source: Source | None, digests: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                w = words(c)
                ids = batch.column(0).slice(c.lo, c.n)
                take = np.arange(len(w.start)) if source is None else source(ids, w)
                start, end, period = find_runs(word_numbers(c, w)[take], w.row)
                row = w.row[start]
                edge = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, end, -1)
                body, off = _collapsed(c, w, take, np.cumsum(edge[:-1]) > 0)
                start, length = start - w.first[row], end - start
                yield (_digest_batch if digests else _listed_batch)(ids, row, start, length, period, body, off)

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _DIGESTS if digests else _LISTED)


def _listed_batch(ids: pa.Array, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray, body: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"]))
    stop = np.maximum(off[1:] - 1, off[:-1])  # without the space after the last word
    texts = pa.array([body[a:b].tobytes().decode() for a, b in zip(off[:-1], stop, strict=True)], pa.string())
    return pa.RecordBatch.from_arrays([ids, lists, texts], names=["doc_id", "runs", "collapsed"])


def _digest_batch(ids: pa.Array, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray, body: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    edge = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(edge)
    order = np.lexsort((period, start, -length, row))
    some = np.flatnonzero(count)
    best = order[edge[some]]
    top = np.zeros((4, n), np.int64)
    top[:, some] = start[best], length[best], period[best], 1000 * length[best] // period[best]
    listed = [f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
    none = hashlib.sha256(b"").hexdigest()
    of_runs = [hashlib.sha256("".join(listed[a:b]).encode()).hexdigest() if b > a else none for a, b in zip(edge[:-1], edge[1:], strict=True)]
    view = memoryview(body)
    of_words = [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    columns = [ids, pa.array(count), *(pa.array(x, mask=count == 0) for x in top), pa.array(of_runs, pa.string()), pa.array(of_words, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _DIGESTS.split(", ")])
