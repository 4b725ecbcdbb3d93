"""Packing documents into fixed token windows: concatenate and cut.

Pass one tokenises every text once, writes the ids to a table in the shared folder and counts tokens: within a task as a
running sum, over tasks as one total each.  The prefix sums over the task totals (as many as input partitions) turn the
running sums into places in the concatenation of the corpus.  Pass two cuts that line at multiples of the window.  Documents
are never shuffled, and only the last window is short.

Defined cases: a null text is empty and gives the end id alone; null and repeated ids stay rows of their own (repeated rows
are packed again); an empty table gives no pieces; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .textops import chunks, ragged
from .tokens import encoder

WINDOW = 1024
END_ID = 0
#: Input partitions up to which their offsets (16 bytes each) are broadcast.
BROADCAST_PARTS = 1_000_000


def tokenize(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """part, before, doc_id, n_tokens and ids (little-endian, 2 bytes each if the vocabulary allows, else 4).

    part: the task that made the row; before: tokens of that task's earlier rows.  n_tokens counts the end id, which is the
    last of ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for c in chunks(batch.column(1)):
                ids, n = enc.encode(c)
                off = np.concatenate(([0], np.cumsum(n + 1)))
                line = np.full(off[-1], end_id, enc.dtype)
                row, k = ragged(n)
                line[off[row] + k] = ids
                blob = pa.Array.from_buffers(pa.binary(), c.n, [None, pa.py_buffer((off * line.itemsize).astype(np.int32)), pa.py_buffer(line)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(c.n, part, np.int32)), pa.array(before + off[:-1]), batch.column(0).slice(c.lo, c.n), pa.array(n + 1), blob], names=["part", "before", "doc_id", "n_tokens", "ids"])
                before += int(off[-1])

    return docs.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, "part int, before long, doc_id long, n_tokens long, ids binary")


def pack(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A piece ends where its document or its window ends; pieces of a window follow one another from offset 0 without gaps.
    """
    lines = written(tokenize(docs, vocabulary, id, text, end_id), "ids")
    totals = lines.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))  # a row for each input partition
    # One row for each input partition; beyond BROADCAST_PARTS an ordinary join does it.
    small = totals.count() <= BROADCAST_PARTS
    placed = lines.join(F.broadcast(base) if small else base, "part").select("doc_id", "n_tokens", (F.col("base") + F.col("before")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            at = batch.column(2).to_numpy()
            wide = np.dtype("<u4")
            doc, k = ragged((at + n - 1) // window - at // window + 1)
            begin = np.maximum(at[doc], (at[doc] // window + k) * window)
            length = np.minimum(at[doc] + n[doc], (begin // window + 1) * window) - begin
            start = begin - at[doc]
            blobs = batch.column(3)
            crc, cuts, now, ids = np.zeros(len(doc), np.int64), [], -1, np.zeros(0, wide)
            for p in range(len(doc)):
                if doc[p] != now:
                    now = doc[p]
                    raw = blobs[int(now)].as_buffer()
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n[now] else "<u4").astype(wide)
                piece = ids[start[p] : start[p] + length[p]]
                crc[p] = zlib.crc32(piece)
                if keep_ids:
                    cuts.append(piece.astype(np.int32))
            columns = [batch.column(0).take(pa.array(doc)), *map(pa.array, (start, length, crc, n[doc], begin // window, begin % window))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(cuts, pa.list_(pa.int32()))] if keep_ids else []), names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    return placed.mapInArrow(cut, ", ".join(f"{x} {'array<int>' if x == 'ids' else 'long'}" for x in names))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """The windows themselves: sequence_id, input_ids, n_tokens and the boundary record of each piece in order.

    Takes pieces with ids.  A short window is padded to the full width, except if its length is a power of two.
    """
    n = F.col("n_tokens")
    whole = F.flatten(F.transform("boundaries", lambda p: p["ids"]))
    short = (n < window) & (n.bitwiseAND(n - 1) != 0)
    return (
        pieces.groupBy("sequence_id")  # at most ``window`` pieces
        .agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("boundaries"), F.sum("length").alias("n_tokens"))
        .withColumn("input_ids", F.when(short, F.concat(whole, F.array_repeat(F.lit(pad_id), (F.lit(window) - n).cast("int")))).otherwise(whole))
        .withColumn("boundaries", F.transform("boundaries", lambda p: p.dropFields("ids")))
    )
