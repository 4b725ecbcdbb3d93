"""Substring dedup by seed and extend.

Seeds are winnowed anchors of 8 words; the documents that share one meet at it (see repeats.py).  A match is extended to the
left and to the right word by word, for all occurrences of a seed in lockstep: after each step two occurrences are still
together if all words so far agree.  A window of ``length`` words that a left and a right extension reach together is a
repeat if its words are those of the first such window; runs of repeated windows are the maximal repeats over the length
threshold, and all of a repeat but its first occurrence is removed.

Defined cases: a null or empty text has no words and keeps the hash of the empty text; null and repeated ids are ordered as
repeats.py says, and of rows that share id and text all but one are repeats; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import HOT, Block, Words, covered_units, with_repeats
from .textops import Chunk, chunks, equal_runs, mix, ragged, same_bytes, word_hashes, words

LENGTH, SEED = 20, 8


def resolver(length: int = LENGTH, seed: int = SEED):
    """Marks the windows of a block that start earlier in it too."""

    def resolve(b: Block) -> np.ndarray:
        c = Chunk(0, len(b.n), b.data, b.off)
        w = words(c)
        h = word_hashes(c, w)
        place = w.first[:-1] + b.anchor
        most = length - seed
        size = np.diff(w.first)
        # Occurrences with equal state after d steps agree on the seed and on d words on that side.
        left = np.zeros((len(b.n), most + 1), np.uint64)
        right = np.zeros((len(b.n), most + 1), np.uint64)
        left[:, 0] = right[:, 0] = mix(b.key.astype(np.int64).view(np.uint64))
        for k in range(seed):
            right[:, 0] = mix(right[:, 0] * np.uint64(0x9E3779B97F4A7C15) + h[place + k])
        for d in range(1, most + 1):
            for state, at, ok in ((left, place - d, b.anchor >= d), (right, place + seed + d - 1, b.anchor + seed + d <= size)):
                state[ok, d] = mix(state[ok, d - 1] * np.uint64(0x9E3779B97F4A7C15) + h[at[ok]])
        i, j = ragged(b.n)
        back = b.anchor[i] - j  # words of window j before the seed
        at, begin = equal_runs(mix(left[i, back] + mix(right[i, most - back] ^ back.astype(np.uint64))))
        first = w.first[:-1][i] + j
        lo, hi = w.start[first], w.end[first + length - 1]
        dup = np.zeros(len(i), bool)
        size = np.diff(begin)
        while len(size):
            # Windows that aren't those of their group's first make a group of their own, until every window has met its equals.
            lead = np.repeat(at[np.cumsum(size) - size], size)
            same = same_bytes(c.data, lo[at], hi[at], lo[lead], hi[lead])
            dup[at[same & (at != lead)]] = True
            size = np.add.reduceat(~same, np.cumsum(size) - size, dtype=np.int64)
            at, size = at[~same], size[size > 0]
        return dup

    return resolve


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and the words left, joined by one space (kept_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                w = words(c)
                gone = covered_units(batch, c, w.first, 2, 3)
                total = np.concatenate(([0], np.cumsum(gone)))
                keep = ~gone
                size = (w.end - w.start + 1)[keep]  # with a space after each word
                row_bytes = np.bincount(w.row[keep], weights=size, minlength=c.n).astype(np.int64)
                row_bytes = np.maximum(row_bytes - 1, 0)  # but none after the last
                out = np.full(int(size.sum()) + 1, 32, np.uint8)
                at = np.concatenate(([0], np.cumsum(size)))[:-1]
                last = np.flatnonzero(np.append(w.row[keep][1:] != w.row[keep][:-1], True)) if keep.any() else np.zeros(0, np.int64)
                drop = np.zeros(len(size), np.int64)
                drop[last] = 1
                at = at - (np.cumsum(drop) - drop)
                word, k = ragged(size - 1)
                out[at[word] + k] = c.data[w.start[keep][word] + k]
                off = np.concatenate(([0], np.cumsum(row_bytes)))
                kept = pa.Array.from_buffers(pa.large_string(), c.n, [None, pa.py_buffer(off), pa.py_buffer(out)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(np.diff(w.first)), pa.array(total[w.first[1:]] - total[w.first[:-1]]), kept], names=["doc_id", "n_words", "n_removed", "kept_text"])

    found = with_repeats(docs, Words(length, seed), resolver(length, seed), id, text, hot)
    found = found.select(F.col("rest")[id].cast("long").alias("doc_id"), "body", "begins", "ends")
    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


