"""Scoring documents with a gated recurrent language model, in numpy, beside a unigram base.

Corpus counts come first: tokens of all training documents, aggregated per batch and then by Spark.  The most frequent words
(a bounded number, FREQUENT) are broadcast with their counts; the counts of the others are met by a join with only the
rare tokens of each document, so no table of all words is ever in one place.

The model's vocabulary grows with the corpus, as the square root of its training tokens (GROWTH): the most frequent words, the
end and one symbol for all other words, whose probability is then shared among them as in the unigram base, so the model is
a distribution over all known words and one unknown.  It is limited only by FREQUENT.  The output is class-factored: softmax
over groups of classes, over the classes of the group, and over the words of the class.  Words are ranked by frequency and a
class ends where the sum of the square roots of its words' shares reaches one, which makes the expected number of scores for a
token small; classes are parted into groups likewise, and the unknown symbol is a group of its own.  The hidden state of a GRU is
carried from window to window, in training (where gradients stop at a window's start: truncated backpropagation) and in
scoring, so a document is always scored whole, however long.

Training is rounds of parallel descent: each round every task trains on its own part of the round's share of the training
documents (the shares of all rounds are all documents, each once), starting from the same parameters.  The parameters are then
averaged, weighted by tokens: blocks of them meet in Spark and are added up as they stream by.

Defined cases: a null or empty text is the end alone; a null id counts as training text; rows that share an id or are equal
are documents of their own; very long texts are scored window by window; an empty table gives an empty result; columns
other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .textops import LOWER, Chunk, chunks, mix, range_hash, row_sums, words

#: Held out: crc32 of the id's text modulo FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 7, 2
FREQUENT = 1 << 18
#: Words of the model: GROWTH times the square root of the training tokens.
GROWTH = 1.5
HIDDEN, EMBEDDING = 32, 16
WINDOW, BATCH = 16, 512
#: The rounds part the training documents among them, so each document is learnt once.
ROUNDS, RATE = 3, 0.015
#: Parameters that travel together.
BLOCK = 4096
#: Tokens that a task lays out at once.
LEARN_TOKENS = 1 << 19
#: Documents scored side by side; probabilities are taken for the tokens of about SCORE_WINDOW of their steps together.
SCORE_BATCH, SCORE_WINDOW = 1024, 32
#: Tokens that a task scores at once (or one longer batch of texts).
SCORE_TOKENS = 1 << 22
#: Scores of a softmax laid out at once, and parameters updated at once: what a core's cache holds.
CELLS, PLACES = 1 << 17, 1 << 16
#: Sums of exponentials beyond these are taken again from shifted scores.
SMALL, LARGE = 1e-26, 1e26

UNKNOWN, END = 0, 1
#: The first 0 to 8 bytes of a little-endian integer, and a last byte that tells shorter words apart and that no UTF-8 text has.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
FILL = np.array([*(0xF8 + k << 56 for k in range(8)), 0], np.uint64)
#: Stands for the end among word hashes, as a word of no bytes.
END_HASH = mix(FILL[:1])[0]


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token of the chunk (every row's words, A-Z lower-cased, then the end) and the first of each row."""
    low = LOWER[c.data]
    w = words(c, low)
    first = w.first + np.arange(c.n + 1)
    out = np.full(first[-1], END_HASH, np.uint64)
    size = w.end - w.start
    h = np.ndarray(len(low) + 1, "<u8", np.concatenate((low, np.zeros(8, np.uint8))), strides=(1,))[w.start]
    short = np.minimum(size, 8)
    h &= KEEP[short]
    h |= FILL[short]
    h = mix(h)  # a bijection: words of at most 8 bytes never meet
    if len(long := np.flatnonzero(size > 8)):
        h[long] = range_hash(low, w.start[long], w.end[long])
    out[np.arange(len(h)) + w.row] = h
    return out, first


def _prepared(docs: DataFrame, id: str, text: str) -> DataFrame:
    i = F.col(id).cast("long")
    return docs.select(i.alias("doc_id"), F.col(text).cast("string").alias("body"), F.coalesce(F.crc32(i.cast("string")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash) and n over all rows of docs (doc_id, body, held_out) that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [tokens(c)[0] for c in chunks(batch.column(0))]
            if not h:
                continue
            h = np.sort(np.concatenate(h))
            head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64)), pa.array(np.diff(np.append(head, len(h))))], names=["word", "n"])

    return docs.where("not held_out").select("body").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Places:
    """Where hashes lie in a sorted array of distinct ones, found by a table of their leading bits."""

    def __init__(self, word: np.ndarray):
        bits = len(word).bit_length() + 1
        self.shift, self.n = np.uint64(64 - bits), len(word)
        self.first = np.searchsorted(word >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        self.word = np.append(word, ~np.uint64(0))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, or of the next larger, and whether it is there."""
        at = self.first[h >> self.shift]
        met = self.word[at]
        low = np.flatnonzero(met < h)
        while len(low):
            at[low] += 1
            met[low] = self.word[at[low]]
            low = low[met[low] < h[low]]
        return at, (met == h) & (at < self.n)


@dataclass
class Frequent:
    """Words of at least ``least`` training occurrences, sorted by hash, and the totals."""

    word: np.ndarray
    n: np.ndarray
    least: int
    total: int
    distinct: int

    def __post_init__(self):
        self.places = Places(self.word)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Count of each token, -1 if it isn't frequent."""
        at, there = self.places.find(h)
        return np.where(there, np.append(self.n, -1)[at], -1)

    def log_base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.total + self.distinct + 1))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> Frequent:
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    least, have = (1 << 62), 0
    for r in sorted(steps, key=lambda r: -r.step):
        if have + r.words > most:
            break
        least, have = r.least, have + r.words
    got = counts.where(F.col("n") >= least).toArrow()  # at most ``most`` rows
    word, n = got["word"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(word)
    return Frequent(word[order], n[order], least, int(total[0] or 0), int(total[1]))


@dataclass
class Lexicon:
    """Model ids of words: UNKNOWN, END, then the most frequent by count."""

    word: np.ndarray  # sorted hashes
    id: np.ndarray
    size: int

    def __post_init__(self):
        self.places, self.known = Places(self.word), np.append(self.id, UNKNOWN).astype(np.int32)

    def ids(self, h: np.ndarray) -> np.ndarray:
        at, there = self.places.find(h)
        return np.where(there, self.known[at], np.int32(UNKNOWN))


def lexicon(f: Frequent, growth: float = GROWTH) -> tuple[Lexicon, np.ndarray]:
    """The lexicon, and the training count of each id."""
    best = np.lexsort((f.word, -f.n))
    best = best[f.word[best] != END_HASH][: math.ceil(growth * math.sqrt(f.total))]
    word = np.concatenate(([END_HASH], f.word[best]))
    ids = np.arange(1, len(word) + 1)
    count = np.concatenate(([0], np.maximum(f.counts(word), 0)))
    count[UNKNOWN] = max(f.total - count.sum(), 0)
    order = np.argsort(word)
    return Lexicon(word[order], ids[order], len(word) + 1), count


class Model:
    """Parameters by name; vectors() and load() turn them into one flat array and back.

    The GRU's are stacked by gate: update, reset, new state.  Rows of Wg are groups, of Wc classes, of Ww words.  The classes of
    group g are group_edge[g] to group_edge[g + 1], the words of class c edge[c] to edge[c + 1].
    """

    def __init__(self, count: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size = size = len(count)
        share = (count + 1) / (count.sum() + size)
        self.cls, self.edge = _parted(share)
        of_class = np.add.reduceat(share, self.edge[:-1])
        self.group, self.group_edge = _parted(of_class)
        of_group = np.add.reduceat(of_class, self.group_edge[:-1])
        self.classes, self.groups = len(of_class), len(of_group)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {
            "E": draw(size, EMBEDDING),
            "Wx": draw(3, EMBEDDING, HIDDEN),
            "b": np.zeros((3, 1, HIDDEN), np.float32),
            "U": draw(3, HIDDEN, HIDDEN),
            "Wg": np.zeros((self.groups, HIDDEN), np.float32),
            "bg": np.log(of_group).astype(np.float32),
            "Wc": np.zeros((self.classes, HIDDEN), np.float32),
            "bc": np.log(of_class / of_group[self.group]).astype(np.float32),
            "Ww": np.zeros((size, HIDDEN), np.float32),
            "bw": np.log(share / of_class[self.cls]).astype(np.float32),
        }

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def levels(self, target: np.ndarray) -> list[tuple[str, int, np.ndarray, list[tuple[slice, slice]]]]:
        """Levels of the output for ordered targets: the letter, the first row that has a place there, the rows' places and the pieces of rows
        that share a softmax, with its places.  The unknown symbol, alone in its group, is settled by the first level."""
        cls = self.cls[target]
        group = self.group[cls]
        known = int(np.searchsorted(target, UNKNOWN, "right"))
        return [
            ("g", 0, group, [(now, slice(0, self.groups)) for now in _pieces(0, len(target), self.groups)]),
            ("c", known, cls[known:], _parts(group[known:], self.group_edge)),
            ("w", known, target[known:], _parts(cls[known:], self.edge)),
        ]


def _parted(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive items in parts, and the parts' edges: the first item alone, then a part ends where the sum of square roots of shares reaches one."""
    root = np.cumsum(np.sqrt(share[1:]))
    part = np.concatenate(([0], 1 + (root - root[0]).astype(np.int64))).astype(np.uint16)
    return part, np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(share))


def _parts(part: np.ndarray, edge: np.ndarray) -> list[tuple[slice, slice]]:
    """Pieces of rows that are ordered by part, each with the items of its part."""
    met, edge = np.searchsorted(part, np.arange(len(edge))).tolist(), edge.tolist()
    return [(now, slice(lo, hi)) for lo, hi, a, b in zip(edge[:-1], edge[1:], met[:-1], met[1:], strict=True) for now in _pieces(a, b, hi - lo)]


def _order(ids: np.ndarray, size: int) -> np.ndarray:
    return np.argsort(ids.astype(np.uint16) if size <= 1 << 16 else ids, kind="stable")  # numpy sorts short integers by radix


def _pieces(lo: int, hi: int, width: int) -> list[slice]:
    """Rows lo to hi in pieces of about CELLS scores."""
    most = max(CELLS // width, 1)
    return [slice(k, min(k + most, hi)) for k in range(lo, hi, most)]


def _signed(p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Wx, b and U with the gates' parts negated: a sigmoid is 1 / (1 + exp(-s))."""
    sign = np.array([-1, -1, 1], p["U"].dtype).reshape(3, 1, 1)
    return p["Wx"] * sign, p["b"] * sign, p["U"] * sign


def _step(x: np.ndarray, h: np.ndarray, U: np.ndarray, g: np.ndarray, out: np.ndarray) -> None:
    """One GRU step from input parts x (3, rows, HIDDEN) and state h to the new state out.

    Gates and candidate state replace x, g gets the parts of h, of which backpropagation needs the last.
    """
    np.matmul(h, U, out=g)
    gates, new = x[:2], x[2]
    gates += g[:2]
    np.exp(gates, out=gates)
    gates += 1
    np.divide(1, gates, out=gates)
    np.multiply(gates[1], g[2], out=out)
    new += out
    new *= -2  # tanh(s) is 2 / (1 + exp(-2 s)) - 1
    np.exp(new, out=new)
    new += 1
    np.divide(2, new, out=new)
    new -= 1
    np.subtract(h, new, out=out)
    out *= gates[0]
    out += new


@np.errstate(all="ignore")
def _layer(h: np.ndarray, W: np.ndarray, b: np.ndarray, at: np.ndarray, pieces: list[tuple[slice, slice]], weight: np.ndarray | None = None, shift: bool = False) -> tuple[np.ndarray, ...]:
    """Log share of one place of each row, where each piece of rows has a softmax over its own places.  Rows are ordered by place.

    With weights also the gradients of the weighted loss, of h, W and b.  Scores are shifted only if a sum of
    exponentials turns out to have overflowed or vanished.
    """
    kind = h.dtype
    total, own, one = np.empty(len(h), kind), np.empty(len(h), kind), np.ones(len(W), kind)
    if weight is not None:
        dh, dW, db = np.empty_like(h), np.zeros_like(W), np.zeros_like(b)
    rows = [now.stop - now.start for now, _ in pieces]
    width, begin, skip = (np.repeat(x, rows) for x in ([w.stop - w.start for _, w in pieces], [w.start for _, w in pieces], [now.start for now, _ in pieces]))
    places = (np.arange(len(at)) - skip) * width + at - begin if len(at) else at  # in the piece's scores
    for now, w in pieces:
        x, V, sums = h[now], W[w], total[now]
        z = x @ V.T
        z += b[w]
        if shift:
            z -= z.max(axis=1, keepdims=True)
        flat, place = z.reshape(-1), places[now]
        own[now] = flat[place]
        np.exp(z, out=z)
        np.matmul(z, one[: z.shape[1]], out=sums)
        if weight is not None:
            flat[place] -= sums
            scale = weight[now] / sums
            np.matmul(z, V, out=dh[now])
            x = x * scale[:, None]
            if now.start and at[now.start - 1] >= w.start:  # not the first piece of these places
                dW[w] += z.T @ x
            else:
                np.matmul(z.T, x, out=dW[w])
            db[w] += scale @ z
    if not shift and len(h) and not (total.min() > SMALL and total.max() < LARGE):
        return _layer(h, W, b, at, pieces, weight, True)
    share = own - np.log(total)
    if weight is None:
        return (share,)
    dh *= (weight / total)[:, None]
    return share, dh, dW, db


def log_probabilities(model: Model, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target id after each state."""
    order = _order(target, model.size)
    h, share, out = h[order], np.zeros(len(order)), np.empty(len(order))
    for k, lo, at, pieces in model.levels(target[order]):
        share[lo:] += _layer(h[lo:], model.p["W" + k], model.p["b" + k], at, pieces)[0]
    out[order] = share
    return out


@np.errstate(over="ignore")
def score_documents(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log probability of each document's tokens ids[first[i]:first[i + 1]]; each begins after an end, from the zero state."""
    n = np.diff(first)
    out = np.zeros(len(n))
    order = np.argsort(-n, kind="stable")
    Wx, b, U = _signed(model.p)
    inputs = np.matmul(model.p["E"], Wx) + b
    states, targets, owners, held = [], [], [], 0

    def add() -> None:
        got = log_probabilities(model, np.concatenate(states), np.concatenate(targets))
        out[:] += np.bincount(np.concatenate(owners), weights=got, minlength=len(out))
        for x in (states, targets, owners):
            x.clear()

    for lo in range(0, len(order), SCORE_BATCH):
        rows = order[lo : lo + SCORE_BATCH]
        steps, begin = int(n[rows[0]]), first[rows]
        live = np.searchsorted(-n[rows], -np.arange(steps), "left").tolist()  # rows are ordered by length
        h, before = np.zeros((len(rows), HIDDEN), np.float32), np.full(len(rows), END)
        for t, now in enumerate(live):
            x, g, after = np.take(inputs, before[:now], axis=1), np.empty((3, now, HIDDEN), np.float32), np.empty((now, HIDDEN), np.float32)
            _step(x, h[:now], U, g, after)  # the others have ended
            h, before = after, ids[begin[:now] + t]
            states.append(h)
            targets.append(before)
            owners.append(rows[:now])
            held += now
            if held >= SCORE_BATCH * SCORE_WINDOW:
                add()
                held = 0
    if held:
        add()
    return out


@np.errstate(over="ignore")
def gradients(model: Model, x: np.ndarray, y: np.ndarray, mask: np.ndarray, h0: np.ndarray, carry: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean loss over a window (steps x rows of input ids, target ids and weights), the last state, the loss.

    carry is 0 where a document begins, so that the state starts from zero there, and 1 elsewhere.
    """
    p, kind = model.p, h0.dtype
    steps, rows = x.shape
    begins = [np.flatnonzero(c == 0) for c in carry] if carry is not None else [np.zeros(0, int)] * steps
    Wx, b, U = _signed(p)
    emb = p["E"][x.ravel()]
    inp = np.matmul(emb, Wx)
    inp += b
    inp = inp.reshape(3, steps, rows, HIDDEN)
    gate, new = inp[:2], inp[2]
    before, after, part, dn = np.empty((4, steps, rows, HIDDEN), kind)
    g = np.empty((3, rows, HIDDEN), kind)
    h = h0
    for t in range(steps):
        before[t] = h
        before[t][begins[t]] = 0
        h = after[t]
        _step(inp[:, t], before[t], U, g, h)
        part[t] = g[2]
    H = after.reshape(-1, HIDDEN)
    target, weight = y.ravel(), (mask.ravel() / max(float(mask.sum()), 1.0)).astype(kind)
    order = _order(target, model.size)
    H, weight, own, grad, loss = H[order], weight[order], np.zeros_like(H), {}, 0.0
    for k, lo, at, pieces in model.levels(target[order]):
        share, dh, grad["W" + k], grad["b" + k] = _layer(H[lo:], p["W" + k], p["b" + k], at, pieces, weight[lo:])
        own[lo:] += dh
        loss -= float(share @ weight[lo:])
    dH = np.empty_like(own)
    dH[order] = own
    dH = dH.reshape(steps, rows, HIDDEN)
    dg, back = np.empty((3, steps, rows, HIDDEN), kind), np.zeros((rows, HIDDEN), kind)
    UT, s, u = np.ascontiguousarray(p["U"].transpose(0, 2, 1)), np.empty_like(back), np.empty_like(back)
    for t in range(steps - 1, -1, -1):
        d, z, r = dH[t], gate[0, t], gate[1, t]
        d += back
        np.subtract(1, z, out=s)
        np.multiply(new[t], new[t], out=u)
        np.subtract(1, u, out=u)
        u *= s
        np.multiply(d, u, out=dn[t])
        np.subtract(before[t], new[t], out=u)
        u *= s
        np.multiply(d, z, out=s)
        np.multiply(s, u, out=dg[0, t])
        np.subtract(1, r, out=u)
        u *= part[t]
        np.multiply(dn[t], r, out=dg[2, t])
        np.multiply(dg[2, t], u, out=dg[1, t])
        np.matmul(dg[:, t], UT, out=g)
        np.add(g[0], g[1], out=back)
        back += g[2]
        back += s
        back[begins[t]] = 0
    flat = dg.reshape(3, -1, HIDDEN)
    grad["U"] = np.matmul(before.reshape(-1, HIDDEN).T, flat)
    dg[2] = dn
    grad["Wx"], grad["b"] = np.matmul(emb.T, flat), np.ones((1, flat.shape[1]), kind) @ flat
    to_emb = flat[0] @ p["Wx"][0].T
    for f, w in zip(flat[1:], p["Wx"][1:], strict=True):
        to_emb += f @ w.T
    order = _order(x.ravel(), model.size)
    seen = x.ravel()[order]
    head = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
    grad["E"] = np.zeros_like(p["E"])
    grad["E"][seen[head]] = np.add.reduceat(to_emb[order], head)
    return grad, h, loss


class Trainer:
    """Adam over documents that are laid end to end in BATCH lanes, WINDOW steps at a time; states run on from window to window."""

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate, self.steps, self.seen = model, rate, 0, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def learn(self, ids: np.ndarray, first: np.ndarray) -> None:
        """One pass over documents ids[first[i]:first[i + 1]]; only a document that a lane's end cuts starts again from zero."""
        n = len(ids)
        if not n:
            return
        lanes = min(BATCH, -(-n // WINDOW))
        width = -(-n // (lanes * WINDOW)) * WINDOW
        begins = np.zeros(lanes * width, bool)
        begins[first[:-1]] = True
        before = np.concatenate(([END], ids[:-1]))
        before[first[:-1]] = END
        shape = lambda a: np.concatenate((a, np.zeros(lanes * width - n, a.dtype))).reshape(lanes, width).T.copy()
        x, y, mask = shape(before), shape(ids), shape(np.ones(n, np.float32))
        carry = (~begins).astype(np.float32).reshape(lanes, width).T.copy()
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, width, WINDOW):
            now = slice(t, t + WINDOW)
            g, h, _ = gradients(self.model, x[now], y[now], mask[now], h, carry[now])
            self._update(g)
        self.seen += n

    def _update(self, g: dict[str, np.ndarray]) -> None:
        clip = min(1.0, 1.0 / (math.sqrt(sum(float(np.vdot(a, a)) for a in g.values())) + 1e-9))
        self.steps += 1
        still = math.sqrt(1 - 0.999**self.steps)
        pace = self.rate / (1 - 0.9**self.steps) * still
        s = np.empty(PLACES, np.float32)
        for k, a in g.items():
            whole = [x.reshape(-1) for x in (a, self.m[k], self.v[k], self.model.p[k])]
            for lo in range(0, a.size, PLACES):
                a, m, v, p = (x[lo : lo + PLACES] for x in whole)
                t = s[: len(a)]
                np.multiply(a, 0.1 * clip, out=t)
                m *= 0.9
                m += t
                np.multiply(a, a, out=t)
                t *= 0.001 * clip * clip
                v *= 0.999
                v += t
                np.sqrt(v, out=t)
                t += 1e-8 * still
                np.divide(m, t, out=t)
                t *= pace
                p -= t


def _added(blocks: DataFrame) -> DataFrame:
    """The sum of the arrays x of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(0)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["block", "x"])

        for batch in batches:  # sorted by block
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = x.values.to_numpy()
                if block == last:
                    total = total + x
                    continue
                if last is not None:
                    yield out()
                last, total = block, x
        if last is not None:
            yield out()

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, x array<double>")


def fit(docs: DataFrame, words: Lexicon, count: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Rounds of parallel training on docs (doc_id, body, held_out), averaged by Spark."""
    model = Model(count)
    size = len(model.vector())
    for k in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((words, count, model.vector()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words, count, start = sent.value
            trainer = Trainer(Model(count).load(start))
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def flush() -> None:
                sizes = np.concatenate([np.diff(f) for _, f in held])
                trainer.learn(np.concatenate([i for i, _ in held]), np.concatenate(([0], np.cumsum(sizes))))
                held.clear()

            for batch in batches:
                for c in chunks(batch.column(0)):
                    h, first = tokens(c)
                    held.append((words.ids(h), first))
                    if sum(len(i) for i, _ in held) >= LEARN_TOKENS:
                        flush()
            if held:
                flush()
            if seen := trainer.seen:
                flat = np.append(trainer.model.vector() * np.float32(seen), np.zeros(-size % BLOCK, np.float32))
                blocks = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BLOCK, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), blocks], names=["block", "x"])
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([[float(seen)]], pa.list_(pa.float32()))], names=["block", "x"])

        mine = docs.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", "body"), F.lit(rounds)) == k)).select("body")
        got = _added(mine.mapInArrow(run, "block long, x array<float>").select("block", F.col("x").cast("array<double>").alias("x"))).orderBy("block").toArrow()  # as large as the model
        if got.num_rows:
            total, flat = got["x"][0].values.to_numpy()[0], np.concatenate([x.values.to_numpy() for x in got["x"][1:]])
            model.load(flat[:size] / total)
        sent.unpersist()
    return model


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of whole documents)."""
    docs = _prepared(docs, id, text)
    counts = written(word_counts(docs), "words")
    frequent = frequent_words(counts)
    words, count = lexicon(frequent)
    model = fit(docs, words, count)
    known = frequent.log_base(np.maximum(frequent.counts(words.word), 0))
    other = math.log10(max(1 - float((10**known).sum()), 1e-12))  # what the base leaves to words that the model doesn't have
    sent = docs.sparkSession.sparkContext.broadcast((frequent, words, count, model.vector()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, words, count, flat = sent.value
        model, number = Model(count).load(flat), np.append(words.ids(frequent.word), np.int32(UNKNOWN))
        log_base = np.append(frequent.log_base(frequent.n), 0.0)
        unknown_base = np.where(number == UNKNOWN, log_base - other, 0.0)
        unknown_base[-1] = 0.0  # rare words: below
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            lo = 0

            def flush(hi: int, batch=batch, held=held) -> pa.RecordBatch:
                ids, size, base, unknown, rare, rare_n = (np.concatenate(x) for x in zip(*held, strict=True))
                net = score_documents(model, ids, np.concatenate(([0], np.cumsum(size)))) / math.log(10)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(rare_n))).astype(np.int32)), pa.array(rare.view(np.int64)))
                held.clear()
                mine = batch.slice(lo, hi - lo)
                return pa.RecordBatch.from_arrays([mine.column(0), mine.column(2), pa.array(size), pa.array(base), pa.array(net + unknown), lists], names=["doc_id", "held_out", "n_tokens", "base", "net", "rare"])

            for c in chunks(batch.column(1)):
                h, first = tokens(c)
                at, there = frequent.places.find(h)
                at[~there] = len(frequent.word)
                sums = [np.concatenate(([0.0], np.cumsum(x[at]))) for x in (log_base, unknown_base)]
                base, unknown = (s[first[1:]] - s[first[:-1]] for s in sums)
                held.append((number[at], np.diff(first), base, unknown, h[~there], row_sums(~there, first)))
                if sum(len(x[0]) for x in held) >= SCORE_TOKENS:
                    yield flush(c.hi)
                    lo = c.hi
            if held:
                yield flush(c.hi)

    scored = docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, base double, net double, rare array<long>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    met = rare.join(counts.where(F.col("n") < frequent.least), "word", "left")
    room = float(frequent.total + frequent.distinct + 1)
    met = met.groupBy("row").agg(F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(room))).alias("rare_score"), F.sum(F.when(F.col("n").isNull(), F.col("times")).otherwise(0)).alias("unseen"))
    rare_score = F.coalesce("rare_score", F.lit(0.0))
    return scored.join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - F.coalesce("unseen", F.lit(0))).alias("n_known"),
        F.lit(frequent.total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_score).alias("base_score"),
        # Rare words are not in the model's vocabulary: what they add to the base they add here, less the share of all such words.
        (F.col("net") + rare_score - F.size("rare") * F.lit(other)).alias("score"),
    )
