"""Windows of token arrays in Arrow: all windows of a batch at once, their 64-bit keys and their polynomial hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .sequences import HASH_BASE, HASH_MODULUS

#: Tokens whose windows are worked on at once in a task; one longer sequence is taken whole.
STEP = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_keys(tokens: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each n consecutive tokens, from keys of windows of half the size (and one more where n is odd)."""
    one = mix(tokens.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if n == 1:
        return one
    half = window_keys(tokens, n // 2)
    h = n // 2
    out = mix(half[: len(half) - h] * np.uint64(0xD6E8FEB86659FD93) + half[h:]) if len(half) > h else half[:0]
    if n % 2:
        out = mix(out[: len(out) - 1] * np.uint64(0xD6E8FEB86659FD93) + one[n - 1 : n - 2 + len(out)]) if len(out) else out
    return out


def polynomial_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """sum(token * HASH_BASE**i) modulo HASH_MODULUS of each n consecutive tokens below 2**20.

    Powers are taken in limbs of 20 bits, whose sums fit 64 bits for up to 2**20 tokens; the limbs are put together 4 bits at a time, as a
    residue has 60 bits.
    """
    m = len(tokens) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    t = tokens.astype(np.uint64)
    limbs = [np.zeros(m, np.uint64) for _ in range(3)]
    for i in range(n):
        power = pow(HASH_BASE, i, HASH_MODULUS)
        for k in range(3):
            limbs[k] += t[i : i + m] * np.uint64(power >> 20 * k & 0xFFFFF)
    modulus = np.uint64(HASH_MODULUS)
    out = limbs[2] % modulus
    for k in (1, 0):
        for _ in range(5):
            out = (out << np.uint64(4)) % modulus
        out = (out + limbs[k]) % modulus
    return out.astype(np.int64)


@dataclass
class Part:
    """Some rows of a batch: their tokens one after another, and every window of n of them that lies in one row."""

    rows: slice
    tokens: np.ndarray
    start: np.ndarray  # of each window, in tokens
    row: np.ndarray  # of each window, in rows
    offset: np.ndarray  # of each window, in its row


def parts(column: pa.ListArray, n: int, drop_last: bool = False, whole: bool = False) -> list[Part]:
    """The windows of a list column, in parts of about STEP tokens (or ``whole``, in one).  A null list has none; a null token is -1."""
    if column.null_count:
        column = column.fill_null([])
    off = column.offsets.to_numpy().astype(np.int64)
    values = column.values.fill_null(-1).to_numpy() if len(column.values) else np.zeros(0, np.int32)
    out, lo = [], 0
    while lo < len(column):
        hi = len(column) if whole else min(len(column), max(lo + 1, int(np.searchsorted(off, off[lo] + STEP, "right")) - 1))
        count = np.maximum(np.diff(off[lo : hi + 1]) - n + (0 if drop_last else 1), 0)
        row = np.repeat(np.arange(hi - lo), count)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        out.append(Part(slice(lo, hi), values[off[lo] : off[hi]], off[lo:hi][row] - off[lo] + offset, row, offset))
        lo = hi
    return out


def grams(part: Part, windows: np.ndarray, n: int) -> pa.ListArray:
    """The tokens of some windows."""
    at = part.start[windows][:, None] + np.arange(n)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(windows) * n + 1, n, dtype=np.int32)), pa.array(part.tokens[at.ravel()].astype(np.int32)))


def first_of_row(part: Part, n: int) -> np.ndarray:
    """The windows (their numbers) that no earlier window of their row equals: keys bring equal ones together, tokens decide."""
    key = window_keys(part.tokens, n)[part.start]
    order = np.lexsort((part.offset, key, part.row))
    if len(order) < 2:
        return order
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((key[a] == key[b]) & (part.row[a] == part.row[b]))
    step = max(1, STEP // n)
    differs = [at[(part.tokens[part.start[a[at]][:, None] + np.arange(n)] != part.tokens[part.start[b[at]][:, None] + np.arange(n)]).any(axis=1)] for at in (near[lo : lo + step] for lo in range(0, len(near), step))]
    apart = np.concatenate(differs) if differs else near
    if len(apart):  # different windows share a key: rows and tokens are sorted instead
        whole = np.column_stack((part.row, part.tokens[part.start[:, None] + np.arange(n)]))
        return np.sort(np.unique(whole, axis=0, return_index=True)[1])
    new = np.ones(len(order), bool)
    new[near + 1] = False
    return order[new]
