"""Quality rules as a short-circuit cascade.

Rules are cheap or dear, and reject few or many documents.  ``plan_cascade`` times every rule on a bounded sample and
counts what it rejects among the documents that the rules before it would pass; the rule with the most rejections per
second goes first, and so on.  ``apply_rules`` then evaluates each rule only on the documents that are still alive.  The
order changes cost, never the verdict.

Defined cases: a null text has no words (so it fails the word-count rule); a null id stays a row with a null id; rows that
share an id are judged one by one; an empty table gives an empty result; other columns, whatever their names, are kept by
``filter_documents`` and ignored by ``apply_rules``.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Chunk, Words, chunks, covered, equal_runs, gram_hashes, inside, mix, range_hash, repeated, row_sums, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

#: Words of the windows in which repeats are looked for.
WINDOW = 8
#: Documents of the sample that orders the rules; it steers cost only.
SAMPLE_ROWS = 1000


class Facts:
    """What rules ask about the texts of a chunk; each array is made when a rule first asks for it."""

    def __init__(self, c: Chunk):
        self.c = c

    @cached_property
    def words(self) -> Words:
        return words(self.c)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    @cached_property
    def word_chars(self) -> np.ndarray:
        b = self.c.data
        return row_sums(((b & 0xC0) != 0x80) & (b != 32) & ((b < 9) | (b > 13)), self.c.off)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return row_sums(SYMBOLS[self.c.data], self.c.off)

    @cached_property
    def hashes(self) -> np.ndarray:
        return range_hash(self.c.data, self.words.start, self.words.end)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of every line with a word."""
        c, w = self.c, self.words
        full = c.off[:-1] < c.off[1:]
        start = np.union1d(c.off[:-1][full], np.flatnonzero(c.data[:-1] == 10) + 1 if len(c.data) else [])
        start = start.astype(np.int64)
        row = np.searchsorted(c.off, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(c.data)), c.off[row + 1])
        end = end - ((end > start) & (c.data[np.maximum(end, 1) - 1] == 10)) if len(start) else end
        has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        return row[has], range_hash(self.c.data, start[has], end[has])

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self._lines[0], minlength=self.c.n)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        row, h = self._lines
        at, begin = equal_runs(mix(h ^ mix(row.astype(np.uint64))))
        later = np.ones(len(at), bool)
        later[begin[:-1]] = False
        return np.bincount(row[at[later]], minlength=self.c.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        w = self.words
        at = inside(w.first, WINDOW)
        key = mix(gram_hashes(self.hashes, WINDOW)[at] ^ mix(w.row[at].astype(np.uint64))) if len(at) else np.zeros(0, np.uint64)
        return row_sums(covered(at[repeated(key)], WINDOW, len(w.start)), w.first)

    @cached_property
    def n_echo_words(self) -> np.ndarray:
        """Words equal to the word before them."""
        w, h = self.words, self.hashes
        echo = np.zeros(len(h), bool)
        echo[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
        return row_sums(echo, w.first)


@dataclass(frozen=True)
class Rule:
    """reject: from the facts of some texts, True for each text to reject."""

    name: str
    reject: Callable[[Facts], np.ndarray] = field(compare=False)


#: The base rules of the query's contract and common heuristics for prose; all cover whole texts.
RULES = (
    Rule("few_words", lambda f: f.n_words < 20),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 30 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 14 * f.n_words)),
    Rule("repeated_lines", lambda f: 10 * f.n_dup_lines > 3 * f.n_lines),
    Rule("echoed_words", lambda f: 10 * f.n_echo_words > 2 * f.n_words),
)


def _some(c: Chunk, rows: np.ndarray) -> Chunk:
    size = np.diff(c.off)[rows]
    off = np.concatenate(([0], np.cumsum(size)))
    take = np.repeat(c.off[rows] - off[:-1], size) + np.arange(off[-1])
    return Chunk(0, len(rows), c.data[take], off)


def cascade(c: Chunk, rules: Iterable[Rule], facts: Facts | None = None) -> np.ndarray:
    """Place in rules of the first that rejects each text, or -1.

    Once half of the texts at hand are rejected, the rest go on in a chunk of their own, so later rules don't pay for them.
    """
    out = np.full(c.n, -1, np.int32)
    part, rows, alive = facts or Facts(c), np.arange(c.n), np.ones(c.n, bool)
    for k, rule in enumerate(rules):
        if not alive.any():
            break
        bad = rule.reject(part) & alive
        out[rows[bad]] = k
        alive &= ~bad
        if 2 * alive.sum() < len(alive):
            part, rows = Facts(_some(part.c, np.flatnonzero(alive))), rows[alive]
            alive = np.ones(len(rows), bool)
    return out


def plan_cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a bounded sample, each among what those before it pass."""

    took, seen = np.zeros(len(rules)), Counter()
    # take() reads input partitions only until it has enough rows; the sample's size doesn't grow with the table.
    sample = pa.array([r[0] for r in docs.select(F.col(text).cast("string")).take(sample_rows)], pa.string())
    for c in chunks(sample):
        masks = np.zeros(c.n, np.int64)
        for k, rule in enumerate(rules):
            began = time.thread_time()
            masks |= rule.reject(Facts(c)).astype(np.int64) << k
            took[k] += time.thread_time() - began
        seen.update(masks.tolist())
    cost = took + 1e-9
    left, order = list(range(len(rules))), []
    while left:
        gone = sum(1 << k for k in order)
        alive = [(m, n) for m, n in seen.items() if not m & gone]
        best = max(left, key=lambda k: (sum(n for m, n in alive if m >> k & 1) / cost[k], -k))
        order.append(best)
        left.remove(best)
    return [rules[k] for k in order]


def apply_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the first rule that rejects (null if none)."""
    rules = plan_cascade(docs, text) if rules is None else rules
    names = pa.array([r.name for r in rules])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                f = Facts(c)
                first = cascade(c, rules, f)
                base = (f.n_words < 20) | (100 * f.n_repeat_words > 30 * f.n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.n), *(pa.array(x.astype(np.int64)) for x in (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words)), pa.array(base), pa.array(~base & (first < 0)), names.take(pa.array(first, mask=first < 0))],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
                )

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(
        judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    )


def filter_documents(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    rules = plan_cascade(docs, text) if rules is None else rules
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [cascade(c, rules) < 0 for c in chunks(batch.column(place))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(keep, docs.schema)

