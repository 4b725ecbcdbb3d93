"""Chat formatting by columnar byte assembly.

A turn becomes  <|turn|> role <|text|>\\n text <|end|>\\n .  Inside roles and texts each of  < [ \\  is followed by a
backslash, so no control string (this template's or another's such as [INST] or </s>) is left there, and a marker is a  <
that no backslash follows.  ``format_turns`` works on turns, not on whole conversations: segment lengths, their running sums
and scatter indices are computed for a batch of turns at once and everything is copied into one preallocated buffer, which
becomes the Arrow column.  A conversation's text is its turns' pieces in order; ``read_back`` parses those pieces, streaming
through partitions sorted by conversation and turn, so a conversation of any length needs the memory of one batch.

Defined cases: null texts and roles are empty; a null conv_id is a conversation of its own; turns that tie are ordered by
role and then text, a null turn first; repeated rows are turns of their own; an empty table gives no conversations; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Chunk, chunks, text_buffers

OPEN, MIDDLE, CLOSE = b"<|turn|>", b"<|text|>\n", b"<|end|>\n"
#: Bytes after which an escape stands.
_ESCAPED = np.zeros(256, bool)
_ESCAPED[np.frombuffer(b"<[\\", np.uint8)] = True
_BACKSLASH = 92


def _escape_into(out: np.ndarray, at: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
    """Writes each text, escaped, to out from its place in at."""
    special = _ESCAPED[data]
    extra = np.concatenate(([0], np.cumsum(special)))
    target = np.arange(len(data)) + extra[:-1] + np.repeat(at - off[:-1] - extra[off[:-1]], np.diff(off))
    out[target] = data
    out[target[special] + 1] = _BACKSLASH


def _escaped_lengths(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    extra = np.concatenate(([0], np.cumsum(_ESCAPED[data])))
    return np.diff(off) + extra[off[1:]] - extra[off[:-1]]


def unescape(data: np.ndarray) -> np.ndarray:
    """The bytes without their escapes.  In a run of backslashes the first is an escape if < or [ stands before it; the rest are pairs."""
    slash = data == _BACKSLASH
    if not slash.any():
        return data
    begin = slash.copy()
    begin[1:] &= ~slash[:-1]
    at = np.flatnonzero(slash)
    first = np.flatnonzero(begin)
    start = first[np.searchsorted(first, at, "right") - 1]
    before = data[np.maximum(start - 1, 0)]
    led = (start > 0) & ((before == 60) | (before == 91))
    drop = at[(at - start) % 2 == np.where(led, 0, 1)]
    keep = np.ones(len(data), bool)
    keep[drop] = False
    return data[keep]


def format_batch(roles: pa.Array, c: Chunk) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The piece of each turn, and where its text begins and ends in it (bytes)."""
    r_data, r_off = text_buffers(roles)
    r_data, r_off = r_data[r_off[0] : r_off[-1]], r_off - r_off[0]
    r_len, t_len = _escaped_lengths(r_data, r_off), _escaped_lengths(c.data, c.off)
    begin = len(OPEN) + r_len + len(MIDDLE)
    size = begin + t_len + len(CLOSE)
    off = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(off[-1], np.uint8)
    for mark, at in ((OPEN, off[:-1]), (MIDDLE, off[:-1] + len(OPEN) + r_len), (CLOSE, off[1:] - len(CLOSE))):
        out[(at[:, None] + np.arange(len(mark))).ravel()] = np.tile(np.frombuffer(mark, np.uint8), c.n)
    _escape_into(out, off[:-1] + len(OPEN), r_data, r_off)
    _escape_into(out, off[:-1] + begin, c.data, c.off)
    return pa.Array.from_buffers(pa.large_string(), c.n, [None, pa.py_buffer(off), pa.py_buffer(out)]).cast(pa.string()), begin, begin + t_len


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted and the byte range of formatted that bears loss (assistant texts; else empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(3)):
                role = batch.column(2).slice(c.lo, c.n)
                piece, begin, end = format_batch(role, c)
                loss = np.array(role.fill_null("").to_numpy(zero_copy_only=False) == "assistant", bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), batch.column(1).slice(c.lo, c.n), role, piece, pa.array(begin), pa.array(np.where(loss, end, begin))], names=["conv_id", "turn", "role", "formatted", "loss_begin", "loss_end"])

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(run, "conv_id long, turn long, role string, formatted string, loss_begin long, loss_end long")


def _parse(raw: np.ndarray) -> tuple[bytes, bytes]:
    """Role and text of a piece."""
    mark = np.flatnonzero(raw == 60)
    mark = mark[raw[mark + 1] != _BACKSLASH]
    a, b, e = (int(x) for x in mark)
    return unescape(raw[a + len(OPEN) : b]).tobytes(), unescape(raw[b + len(MIDDLE) : e]).tobytes()


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, parsed from the formatted pieces: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, False
        n = loss_chars = chars = 0
        all_turns, loss = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if "sha" in name else pa.int64()) for x, name in zip(columns, names, strict=True)], names=names)

        for batch in batches:
            ids, begin, end = batch.column(0).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            data, off = text_buffers(batch.column(1))
            for i, conv in enumerate(ids):
                if not have or conv != now:
                    if have:
                        done.append((now, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    now, have, n, loss_chars, chars = conv, True, 0, 0, 0
                    all_turns, loss = hashlib.sha256(), hashlib.sha256()
                raw = data[off[i] : off[i + 1]]
                role, text = _parse(raw)
                n += 1
                chars += int(np.count_nonzero((raw & 0xC0) != 0x80))
                for part in (role, b"\n", text, b"\n"):
                    all_turns.update(part)
                if end[i] > begin[i]:
                    masked = unescape(raw[begin[i] : end[i]])
                    loss.update(masked)
                    loss_chars += int(np.count_nonzero((masked & 0xC0) != 0x80))
            yield flush()
            done.clear()
        if have:
            done.append((now, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        yield flush()

    # A piece begins with the role and goes on with the text, so ordering ties by it orders them by role and text.
    rows = formatted.select("conv_id", "formatted", "loss_begin", "loss_end", "turn")
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "formatted")
        .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )
