"""Numpy views of Arrow text columns: chunks of bounded size, word boundaries, hashes.

Spark deals out the rows; these helpers only work on the Arrow batches inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once in a task; one longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

#: The bytes that separate words: space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Chunk:
    """Texts lo to hi of a batch; text i has the bytes data[off[i]:off[i + 1]]."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def raw(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64) of a string or binary column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    n = len(col)
    _, offsets, data = col.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), off


def chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column in runs of rows of at most ``most`` bytes (or one longer row)."""
    data, off = text_buffers(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


@dataclass
class Words:
    """Words of a chunk in order: byte ranges, the row of each, and how many words each row has before."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # length rows + 1: index of each row's first word


def words(c: Chunk, data: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes other than IS_SPACE; a row's end also ends a word."""
    data = c.data if data is None else data
    word = ~IS_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edges = c.off[:-1][c.off[:-1] < c.off[1:]]
    begin[edges] = word[edges]
    start = np.flatnonzero(begin)
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    last = c.off[1:][c.off[:-1] < c.off[1:]] - 1
    stop[last] = word[last]
    end = np.flatnonzero(stop) + 1
    first = np.searchsorted(start, c.off)
    return Words(start, end, np.repeat(np.arange(c.n), np.diff(first)), first)


#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Ranges of more bytes are hashed one by one.
LONG_RANGE = 4096


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range data[start:end].  Every 8 bytes go through a multiplication of their own, so no family of
    texts (as the Thue-Morse words for a polynomial) shares a hash by construction; all ranges advance together."""
    size = end - start
    lane = np.ascontiguousarray(np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,)))
    begin = [np.uint64((seed + p) % (1 << 64)) for p in (int(P1) + int(P2), int(P2), 0, -int(P1), int(P5))]
    acc = np.full(len(size), begin[4], np.uint64)
    many = np.flatnonzero((size >= 32) & (size <= LONG_RANGE))
    if len(many):
        stripes = size[many] >> 5
        many = many[np.argsort(-stripes, kind="stable")]
        stripes = size[many] >> 5
        v = [np.full(len(many), x, np.uint64) for x in begin[:4]]
        # Sorted by length, so the ranges that have stripe k are the first ones.
        for k, live in enumerate(np.searchsorted(-stripes, -np.arange(stripes[0]), "left")):
            at = start[many[:live]] + 32 * k
            for j in range(4):
                v[j][:live] = _lane(v[j][:live], lane[at + 8 * j])
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ _lane(np.zeros_like(x), x)) * P1 + P4
        acc[many] = h
    acc += size.astype(np.uint64)
    at, left = start + (size & ~31), size & 31
    for k in range(3):
        go = np.flatnonzero(left >= 8 * (k + 1))
        if len(go):
            acc[go] = _rotl(acc[go] ^ _lane(np.zeros(len(go), np.uint64), lane[at[go] + 8 * k]), 27) * P1 + P4
    at, left = at + (left & ~7), left & 7
    go = np.flatnonzero(left >= 4)
    if len(go):
        acc[go] = _rotl(acc[go] ^ ((lane[at[go]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at, left = at + (left & ~3), left & 3
    for k in range(3):
        go = np.flatnonzero(left > k)
        if len(go):
            acc[go] = _rotl(acc[go] ^ (data[at[go] + k].astype(np.uint64) * P5), 11) * P1
    acc = (acc ^ (acc >> np.uint64(33))) * P2
    acc = (acc ^ (acc >> np.uint64(29))) * P3
    acc ^= acc >> np.uint64(32)
    if len(long := np.flatnonzero(size > LONG_RANGE)):
        from xxhash import xxh64_intdigest

        acc[long] = [xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed) for i in long]
    return acc


def byte_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as an integer that sorts like them; zeros follow the end."""
    n = len(data)
    rows = n // 8 + 1
    padded = np.concatenate((data, np.zeros(8 * rows + 8 - n, np.uint8)))
    out = np.empty((rows, 8), np.uint64)
    for k in range(8):
        out[:, k] = np.frombuffer(padded, ">u8", rows, k)
    return out.ravel()[:n]


def word_hashes(c: Chunk, w: Words, data: np.ndarray | None = None) -> np.ndarray:
    return range_hash(c.data if data is None else data, w.start, w.end)


_ROLL = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; entry i is of words i to i + n - 1 (rows are not told apart)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m] * _ROLL[0]
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _ROLL[k % 64] + h[k : k + m]
    return mix(out)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of n-grams that lie in one row, given first[] of the rows."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    total = int(count.sum())
    begin = np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    return begin + np.arange(total)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item of each group: the group, and the item's place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    return group, at


def same_bytes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether data[lo:hi] are the bytes data[other_lo:other_hi], for each pair of ranges; about ``most`` bytes at once."""
    size = hi - lo
    out = size == other_hi - other_lo
    pairs = np.flatnonzero(out)
    total = np.cumsum(size[pairs])
    for p in np.split(pairs, np.searchsorted(total, np.arange(most, total[-1], most))) if len(pairs) else ():
        row, k = ragged(size[p])
        differs = data[lo[p][row] + k] != data[other_lo[p][row] + k]
        out[p[row[differs]]] = False
    return out


def equal_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose key occurs at least twice, ordered by key and then place; and where each key's run begins (with the end)."""
    n = len(keys)
    bits = np.uint64(max(1, int(n - 1).bit_length()) if n else 1)
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = (keys & ~low) | np.arange(n, dtype=np.uint64)
    packed.sort()  # one plain sort of key and place together; keys that only share their high bits are parted below
    high = packed >> bits
    same = high[1:] == high[:-1]
    near = np.zeros(n, bool)
    near[1:] |= same
    near[:-1] |= same
    at = (packed[near] & low).astype(np.int64)
    k = keys[at]
    order = np.lexsort((at, k))
    at, k = at[order], k[order]
    new = np.ones(len(at), bool)
    new[1:] = k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    many = np.repeat(size > 1, size)
    at = at[many]
    size = size[size > 1]
    return at, np.concatenate(([0], np.cumsum(size))).astype(np.int64)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where the key occurs more than once."""
    out = np.zeros(len(keys), bool)
    out[equal_runs(keys)[0]] = True
    return out


def seen_before(keys: np.ndarray) -> np.ndarray:
    """True where an earlier entry has the same key."""
    at, begin = equal_runs(keys)
    out = np.zeros(len(keys), bool)
    out[at] = True
    out[at[begin[:-1]]] = False
    return out


def row_sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many entries of each row's range are set."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the n places that lie in [s, s + width) for some start."""
    edge = np.zeros(n + width + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:n]) > 0
