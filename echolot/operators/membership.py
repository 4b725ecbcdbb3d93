"""A test of 64-bit keys for membership in a table of any size, inside a scan.

The keys become bits of a Bloom filter in slices of bounded bytes.  A key belongs to one slice, so a task builds a slice from its own keys
alone, and slices are as even as hashes are.  ``scans`` hands out as many slices at a time as may be broadcast: a scan tests its keys in
those slices only, and the scans together pass every wanted key and few others.  A table that would take more than ``SCANS`` of
them isn't worth it: then the filter passes everything, and the caller's join decides alone.  No key is ever dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import mix
from ..scratch import written

#: Bits for each key, of which BITS_SET are set in one 64-bit word: about 1 % of other keys pass.
BITS_PER_KEY, BITS_SET = 16, 5
SLICE_BYTES, SCAN_BYTES, SCANS = 8 << 20, 64 << 20, 8


def _places(key: np.ndarray, slices: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice, word in it, and bits in the word of each key."""
    h = mix(key.view(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    part = ((h >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
    word = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(words)) >> np.uint64(32)
    bits, g = np.zeros(len(key), np.uint64), mix(h)
    for k in range(BITS_SET):
        bits |= np.uint64(1) << (g >> np.uint64(6 * k) & np.uint64(63))
    return part.astype(np.int64), word.astype(np.int64), bits


@dataclass
class Slices:
    """Some slices of a filter; None in place of the table passes every key."""

    first: int
    slices: int
    table: np.ndarray | None  # a row of 64-bit words for each slice from the first on

    def passes(self, key: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.ones(len(key), bool)
        part, word, bits = _places(key, self.slices, self.table.shape[1])
        out = np.zeros(len(key), bool)
        own = np.flatnonzero((part >= self.first) & (part < self.first + len(self.table)))
        out[own] = self.table[part[own] - self.first, word[own]] & bits[own] == bits[own]
        return out


def scans(keys: DataFrame, slice_bytes: int = SLICE_BYTES, scan_bytes: int = SCAN_BYTES, most: int = SCANS) -> Iterator[Slices]:
    """The filter of a table of distinct keys (one long column ``key``), a broadcast of at most ``scan_bytes`` at a time."""
    n = keys.count()
    slices = max(1, -(-n * BITS_PER_KEY // (8 * slice_bytes)))
    together = max(1, scan_bytes // slice_bytes)
    if slices > together * most:
        yield Slices(0, 1, None)
        return
    words = max(1, min(slice_bytes // 8, -(-n * BITS_PER_KEY // 64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_places(key, slices, words)[0]), batch.column(0)], names=["slice", "key"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices come one after another, so a task holds the bits of one."""
        current, table = None, np.zeros(words, np.uint64)
        for batch in batches:
            own, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            _, word, bits = _places(key, slices, words)
            for s in np.unique(own):
                if current is not None and s != current:
                    yield pa.RecordBatch.from_arrays([pa.array([int(current)]), pa.array([table.tobytes()], pa.binary())], names=["slice", "bits"])
                    table = np.zeros(words, np.uint64)
                current = s
                np.bitwise_or.at(table, word[own == s], bits[own == s])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(current)]), pa.array([table.tobytes()], pa.binary())], names=["slice", "bits"])

    dealt = keys.select("key").mapInArrow(place, "slice long, key long").repartition(slices, "slice").sortWithinPartitions("slice")
    built = written(dealt.mapInArrow(build, "slice long, bits binary"), "filter")
    for first in range(0, slices, together):
        table = np.zeros((min(together, slices - first), words), np.uint64)
        for r in built.where(F.col("slice").between(first, first + len(table) - 1)).collect():
            table[r["slice"] - first] = np.frombuffer(r["bits"], np.uint64)
        yield Slices(first, slices, table)
