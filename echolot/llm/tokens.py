"""Byte-level BPE of Arrow text columns.

The public tokenizer splits a text by a fixed pattern and merges within each piece, so a piece always gets the same ids.
Pieces are found for a whole chunk at once in numpy; each distinct piece is given to the tokenizer once per Python worker and
its ids are kept in a bounded hash table.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache

import numpy as np

from .textops import Chunk, ragged, range_hash

_OTHER, _LETTER, _NUMBER, _BLANK = 0, 1, 2, 3
#: Endings that the pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points with Unicode's White_Space property.
BLANKS = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Distinct pieces that a worker remembers before it starts over.
REMEMBER = 1 << 20


@cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[list(BLANKS)] = _BLANK
    return out


def pieces(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Byte start of each piece of the chunk in order (ended by the chunk's size), and the row of each.

    A run of letters, of numbers or of other marks is a piece and takes one space before it; of blanks before a mark the last
    stands apart; an apostrophe that stands alone takes one of ENDINGS.
    """
    cp = np.frombuffer(c.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
    n = len(cp)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    kind = _classes()[cp]
    head = np.zeros(n + 1, bool)  # first character of a row
    head[np.searchsorted(at, c.off)] = True
    run = np.empty(n, bool)
    run[0] = True
    run[1:] = (kind[1:] != kind[:-1]) | head[1:n]
    blank, space = kind == _BLANK, cp == 32
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1] & ~head[1:n]
    start = run & (blank | ~after_space)
    stands = np.zeros(n, bool)  # a blank right before a mark of its row
    stands[:-1] = blank[:-1] & ~blank[1:] & ~head[1:n]
    start |= stands
    for i in np.flatnonzero((cp == 39) & run & ~after_space):
        if i + 1 < n and kind[i + 1] == _LETTER and not head[i + 1]:
            rest = "".join(chr(x) for j, x in enumerate(cp[i + 1 : i + 3]) if not (j and head[i + 2]))
            if hit := next((e for e in ENDINGS if rest.startswith(e)), None):
                start[i + 1] = False
                stop = i + 1 + len(hit)
                if stop < n and not head[stop] and kind[stop] == _LETTER:
                    start[stop] = True
    first = at[:-1][start]
    return np.append(first, at[-1]), np.searchsorted(c.off, first, "right") - 1


class Encoder:
    """Ids of pieces, remembered by hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        vocabulary = self.tokenizer.get_vocab()
        self.opens = [False] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.opens[i] = token[0] == "\u0120"  # how byte-level vocabularies write a space
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(4 * REMEMBER, np.uint64)
        self.place = np.zeros(4 * REMEMBER, np.int32)
        self.n, self.begin, self.pool, self.used = 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 14, self.dtype), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each remembered piece, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        k = self.keys[slot]
        hit = k == h
        out[hit] = self.place[slot[hit]]
        go = np.flatnonzero(~hit & (k != 0))
        while len(go):
            slot[go] = (slot[go] + 1) & int(mask)
            k = self.keys[slot[go]]
            hit = k == h[go]
            out[go[hit]] = self.place[slot[go[hit]]]
            go = go[~hit & (k != 0)]
        return out

    def _remember(self, h: np.ndarray, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        while self.used + size.sum() > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        while self.n + len(h) + 1 > len(self.begin):
            self.begin = np.append(self.begin, np.zeros_like(self.begin))
        self.pool[self.used : self.used + size.sum()] = np.fromiter((x for y in ids for x in y), self.dtype, size.sum())
        self.begin[self.n + 1 : self.n + 1 + len(h)] = self.used + np.cumsum(size)
        number = self.n + np.arange(len(h))
        self.used += int(size.sum())
        self.n += len(h)
        slot = (h & np.uint64(len(self.keys) - 1)).astype(np.int64)
        go = np.arange(len(h))
        while len(go):
            free = self.keys[slot[go]] == 0
            self.keys[slot[go[free]]] = h[go[free]]
            won = self.keys[slot[go]] == h[go]
            self.place[slot[go[won]]] = number[go[won]]
            go = go[~won]
            slot[go] = (slot[go] + 1) & (len(self.keys) - 1)

    def _ids(self, text: list[str]) -> list[list[int]]:
        """Ids of each piece.  A space and letters stay one piece in a longer text, so such pieces are encoded many at once
        and parted again where an id's token begins with the space."""
        plain = [i for i, t in enumerate(text) if t[0] == " " and t[1:].isalpha()]
        rest = sorted({*range(len(text))}.difference(plain))
        out: list[list[int]] = [[]] * len(text)
        for i, e in zip(rest, self.tokenizer.encode_batch([text[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        groups = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        for group, e in zip(groups, self.tokenizer.encode_batch(["".join(text[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            begin = [k for k, x in enumerate(ids) if self.opens[x]]
            if len(begin) != len(group):  # a vocabulary whose tokens don't keep the space in front
                for i in group:
                    out[i] = self.tokenizer.encode(text[i], add_special_tokens=False).ids
                continue
            for i, a, b in zip(group, begin, [*begin[1:], len(ids)], strict=True):
                out[i] = ids[a:b]
        return out

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and how many each row has."""
        start, row = pieces(c)
        h = range_hash(c.data, start[:-1], start[1:]) | np.uint64(1)
        if self.n > REMEMBER:
            self._clear()
        found = self._find(h)
        if len(new := np.flatnonzero(found < 0)):
            _, once = np.unique(h[new], return_index=True)
            once = new[once]
            text = [c.data[start[i] : start[i + 1]].tobytes().decode("utf-8", "replace") for i in once]
            self._remember(h[once], self._ids(text))
            found[new] = self._find(h[new])
        size = self.begin[found + 1] - self.begin[found]
        piece, k = ragged(size)
        return self.pool[self.begin[found][piece] + k], np.bincount(row, weights=size, minlength=c.n).astype(np.int64)


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    return Encoder(path)
