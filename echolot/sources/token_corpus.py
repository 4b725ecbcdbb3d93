"""A Spark data source for token corpora kept as an index file and a file of packed tokens.

Index: 9 magic bytes, version (8-byte integer), type code (1 byte), number of sequences and of documents (8 bytes each), sizes
(4-byte integers), byte pointers and document starts (8-byte integers), all little-endian.  The driver reads only the fixed
header; every partition reads the sizes and pointers of its own row range and seeks to its tokens.

    spark.dataSource.register(TokenCorpus)
    spark.read.format("token_corpus").option("start", 0).option("end", 1000).load("/folder/name")

The path is without .idx and .bin, or a folder of shards, and must be one that the driver and executors can open as files.  Filters on
sequence_id narrow the rows before anything of them is read with option push_filters, which needs spark.sql.python.filterPushdown.enabled.  Writing gives
such a folder: every task writes shards of its own, an index and a file of tokens with pointers as running sums, and the commit
lists the shards of the tasks that count; a failed or repeated task's shards are never listed, and an aborted write leaves nothing.

    rows.write.format("token_corpus").mode("append").save("/folder")

``read_records`` reads rows of a fixed width without index from any file system that Spark knows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: The format's magic bytes and type codes.
MAGIC = b"MMIDIDX\x00\x00"
TYPES = {1: "u1", 2: "i1", 3: "<i2", 4: "<i4", 5: "<i8", 6: "<f4", 7: "<f8", 8: "<u2"}
_HEADER = struct.Struct("<QBQQ")
ROWS_A_PARTITION = 1 << 16


@dataclass(frozen=True)
class Header:
    dtype: str
    rows: int
    documents: int

    @property
    def sizes_at(self) -> int:
        return len(MAGIC) + _HEADER.size

    @property
    def pointers_at(self) -> int:
        return self.sizes_at + 4 * self.rows


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a token index")
        version, code, rows, documents = _HEADER.unpack(f.read(_HEADER.size))
    if version != 1 or code not in TYPES:
        raise ValueError(f"{path} has version {version} and type {code}")
    return Header(TYPES[code], rows, documents)


def write_corpus(path: str, sequences: list[list[int]], code: int = 8) -> None:
    """A small corpus in this format, as for tests and exchange."""
    dtype = np.dtype(TYPES[code])
    sizes = np.array([len(x) for x in sequences], "<i4")
    pointers = np.concatenate(([0], np.cumsum(sizes.astype("<i8"))[:-1])).astype("<i8") * dtype.itemsize if len(sizes) else np.zeros(0, "<i8")
    with open(f"{path}.idx", "wb") as f:
        f.write(MAGIC + _HEADER.pack(1, code, len(sizes), len(sizes)) + sizes.tobytes() + pointers.tobytes() + np.arange(len(sizes), dtype="<i8").tobytes())
    with open(f"{path}.bin", "wb") as f:
        for x in sequences:
            f.write(np.array(x, dtype).tobytes())


#: The list of a folder's shards.
SHARDS = "_shards.json"
#: Bytes of tokens after which a task begins another shard.
SHARD_BYTES = 1 << 30


def shards(path: str) -> list[str]:
    """The corpora of a path: those that a folder lists, in order, or the one that it names."""
    listed = os.path.join(path, SHARDS)
    if not os.path.isdir(path):
        return [path]
    if not os.path.exists(listed):
        raise ValueError(f"{path} is not a token corpus: it has no {SHARDS}")
    with open(listed) as f:
        return [os.path.join(path, name) for name in json.load(f)]


@dataclass
class RowRange(InputPartition):
    """Rows of a corpus, and what is added to their place for their id."""

    path: str
    start: int
    end: int
    base: int


class TokenReader(DataSourceReader):
    def __init__(self, path: str, start: int, end: int | None, step: int, offset: int, length: int | None):
        if offset < 0 or step < 1 or (length is not None and length < 0):
            raise ValueError(f"offset {offset}, length {length} and rows_a_partition {step} must not be negative or empty")
        self.step, self.offset, self.length = step, offset, length
        self.parts = [(p, read_header(f"{p}.idx")) for p in shards(path)]
        if len({h.dtype for _, h in self.parts}) > 1:
            raise ValueError(f"the shards of {path} have different types")
        rows = sum(h.rows for _, h in self.parts)
        self.start, self.end = max(0, start), min(rows, rows if end is None else end)

    def partitions(self) -> list[RowRange]:
        out, base = [], 0
        for path, header in self.parts:
            lo, hi = max(0, self.start - base), min(header.rows, self.end - base)
            out += [RowRange(path, a, min(a + self.step, hi), base) for a in range(lo, hi, self.step)]
            base += header.rows
        return out or [RowRange("", 0, 0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        n = part.end - part.start
        if n <= 0:
            return
        header = read_header(f"{part.path}.idx")
        dtype = np.dtype(header.dtype)
        kind = pa.int32() if dtype.kind in "iu" and dtype.itemsize <= 4 else pa.int64() if dtype.kind in "iu" else pa.float64()
        with open(f"{part.path}.idx", "rb") as f:
            f.seek(header.sizes_at + 4 * part.start)
            sizes = np.frombuffer(f.read(4 * n), "<i4")
            f.seek(header.pointers_at + 8 * part.start)
            pointers = np.frombuffer(f.read(8 * n), "<i8")
        with open(f"{part.path}.bin", "rb") as f:
            for lo in range(0, n, 2048):
                rows = []
                for p, size in zip(pointers[lo : lo + 2048], sizes[lo : lo + 2048], strict=True):
                    take = max(0, int(size) - self.offset if self.length is None else min(self.length, int(size) - self.offset))
                    f.seek(int(p) + self.offset * dtype.itemsize)
                    rows.append(np.frombuffer(f.read(take * dtype.itemsize), dtype))
                    if len(rows[-1]) < take:
                        raise ValueError(f"{part.path}.bin ends within row {part.start + lo + len(rows) - 1}")
                ids = np.arange(part.base + part.start + lo, part.base + part.start + lo + len(rows))
                off = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(rows)).cast(kind))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["sequence_id", "tokens"])


class FilteredTokenReader(TokenReader):
    """The reader that takes filters; Spark refuses one where its pushdown is switched off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on sequence_id become the range of rows that is read; other filters are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("sequence_id",):
                yield f
            elif isinstance(f, EqualTo):
                self.start, self.end = max(self.start, f.value), min(self.end, f.value + 1)
            elif isinstance(f, GreaterThan):
                self.start = max(self.start, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.start = max(self.start, f.value)
            elif isinstance(f, LessThan):
                self.end = min(self.end, f.value)
            elif isinstance(f, LessThanOrEqual):
                self.end = min(self.end, f.value + 1)
            else:
                if isinstance(f, In) and f.value:
                    self.start, self.end = max(self.start, min(f.value)), min(self.end, max(f.value) + 1)
                yield f


@dataclass
class Written(WriterCommitMessage):
    """Shards of a task, in order; place is the task's partition."""

    place: int
    names: list[str]


class TokenWriter(DataSourceArrowWriter):
    """Rows in the order of their partitions; their ids become their places."""

    def __init__(self, path: str, column: int, code: int, replace: bool, shard_bytes: int):
        self.path, self.column, self.code, self.replace, self.shard_bytes = path, column, code, replace, shard_bytes
        os.makedirs(path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        dtype, names = np.dtype(TYPES[self.code]), []
        sizes: list[np.ndarray] = []
        out, done = None, 0

        def close() -> None:
            size = np.concatenate(sizes).astype("<i4")
            pointers = (np.cumsum(size, dtype="<i8") - size) * dtype.itemsize
            with open(os.path.join(self.path, f"{names[-1]}.idx"), "wb") as f:
                f.write(MAGIC + _HEADER.pack(1, self.code, len(size), len(size)) + size.tobytes() + pointers.astype("<i8").tobytes() + np.arange(len(size), dtype="<i8").tobytes())
            out.close()
            sizes.clear()

        for batch in batches:
            lists = batch.column(self.column)
            if lists.null_count or lists.values.null_count:
                raise ValueError("a token corpus has no nulls")
            off = lists.offsets.to_numpy()
            values = lists.values.to_numpy()[off[0] : off[-1]]
            packed = values.astype(dtype)
            if dtype.kind in "iu" and not (packed == values).all():
                raise ValueError(f"a token doesn't fit {dtype}")
            if out is None or done >= self.shard_bytes:
                if out is not None:
                    close()
                names.append(f"{context.partitionId():06d}-{len(names):04d}-{uuid.uuid4().hex[:12]}")
                out, done = open(os.path.join(self.path, f"{names[-1]}.bin"), "wb"), 0
            out.write(packed.tobytes())
            done += packed.nbytes
            sizes.append(np.diff(off))
        if out is not None:
            close()
        return Written(context.partitionId(), names)

    def commit(self, messages: list[Written | None]) -> None:
        """Lists the shards of the tasks that count, after those of before if rows are appended; the list is renamed into place."""
        new = [n for m in sorted((m for m in messages if m is not None), key=lambda m: m.place) for n in m.names]
        listed = os.path.join(self.path, SHARDS)
        old = [os.path.basename(p) for p in shards(self.path)] if os.path.exists(listed) else []
        kept = new if self.replace else old + new
        draft = f"{listed}.{uuid.uuid4().hex[:8]}"
        with open(draft, "w") as f:
            json.dump(kept, f)
        os.replace(draft, listed)
        self._drop(set(old).difference(kept))

    def abort(self, messages: list[Written | None]) -> None:
        self._drop({n for m in messages if m is not None for n in m.names})

    def _drop(self, names: set[str]) -> None:
        for n in names:
            for end in ("idx", "bin"):
                if os.path.exists(path := os.path.join(self.path, f"{n}.{end}")):
                    os.remove(path)


class TokenCorpus(DataSource):
    """Options: path, start and end (rows), offset and length (tokens of each row), rows_a_partition, push_filters; for writing type_code (8: 16 bits) and shard_bytes."""

    @classmethod
    def name(cls) -> str:
        return "token_corpus"

    def schema(self) -> str:
        found = shards(self.options["path"])
        code = read_header(f"{found[0]}.idx").dtype if found else TYPES[8]
        kind = "double" if code.lstrip("<")[0] == "f" else "bigint" if code == "<i8" else "int"
        return f"sequence_id bigint, tokens array<{kind}>"

    def reader(self, schema) -> TokenReader:
        o = self.options
        number = lambda k, d: int(o[k]) if o.get(k) is not None else d
        kind = FilteredTokenReader if str(o.get("push_filters")).lower() == "true" else TokenReader
        return kind(o["path"], number("start", 0), number("end", None), number("rows_a_partition", ROWS_A_PARTITION), number("offset", 0), number("length", None))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        o = self.options
        return TokenWriter(o["path"], schema.fieldNames().index("tokens"), int(o.get("type_code", 8)), overwrite, int(o.get("shard_bytes", SHARD_BYTES)))


def read_records(spark: SparkSession, path: str, width: int = 2049, dtype: str = "<u2") -> DataFrame:
    """sequence_id and tokens of a file of rows of ``width`` tokens each, from any file system that Spark knows (object stores too).

    Hadoop's fixed-length reader splits the file at rows and gives each its place, which is the id.  A file that ends within a
    row is an error of that reader.
    """
    kind = np.dtype(dtype)
    if width < 1 or kind.kind not in "iu" or kind.itemsize > 4:
        raise ValueError(f"rows of {width} tokens of type {dtype} can't be read")
    conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(width * kind.itemsize)}
    # The only reader that Spark has for such files is one of RDDs.
    pairs = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, raw = batch.num_rows, batch.column(1)
            off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1]
            values = np.frombuffer(raw.buffers()[2], kind, n * width, int(off[0])) if n else np.zeros(0, kind)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["sequence_id", "tokens"])

    return spark.createDataFrame(pairs, "sequence_id long, raw binary").mapInArrow(parse, "sequence_id long, tokens array<int>")
