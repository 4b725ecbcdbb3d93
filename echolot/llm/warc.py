"""WARC archives: records written with Spark's text writer, read back and assembled into captures.

A capture is a transaction of a request, a response (or revisit) and a metadata record.  Request and metadata name their
response in WARC-Concurrent-To, and ``assemble`` joins the three by it into one nested row.  Records end in two line ends,
which is the line separator given to the writer, so the part files are gzipped WARC files; ``read_records`` reads whole files
(kept small by ``records_per_file``) and follows Content-Length.

Of captures with equal payloads (of at least ``min_payload`` bytes) the one with the smallest id is a response and the others
are revisits, which carry the HTTP header but not the payload.  The smallest id of each digest is an aggregate that is
combined before the shuffle; it is joined back by digest, a join whose skewed partitions Spark splits.

Defined cases: a null html is an empty payload; a null url is an empty target; pages with a null id are archived with an id
of "null" and compared last; rows that repeat an id are captures of their own, so of equal rows all but one are revisits of
their own id; an empty table writes no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import table_path, written

END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "kind string, record_id string, concurrent_to string, refers_to string, target string, date string, digest string, content_type string, payload_length long, payload binary"


@F.pandas_udf(T.StringType())
def _base32(raw):
    return raw.map(lambda x: base64.b32encode(x).decode())


def digest(payload: Column) -> Column:
    """SHA-1 as bare upper-case base32."""
    return _base32(F.unhex(F.sha1(payload)))


def _record(kind: str, head: dict[str, Column], block: Column) -> Column:
    lines: list[Column] = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}")]
    for name, value in head.items():
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise(F.lit("")))
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def captures(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, payload, digest, a key for each row, and of a revisit the key of its response (origin)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    # Ids that are unique are keys by themselves.  Otherwise rows get numbers, and are written so that both uses below see the same ones.
    unique = rows.groupBy("page_id").count().where("count > 1").isEmpty()
    rows = rows if unique else written(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
    me = F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("id"), (F.lit(0).cast("long") if unique else F.col("row")).alias("row"))
    rows = rows.withColumn("digest", digest(F.col("payload").cast("binary"))).withColumn("me", me)
    # The payload's SHA-256 is a part of the key, so payloads that only share the SHA-1 never meet.
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= min_payload, F.concat(F.col("digest"), F.sha2("payload", 256))))
    first = rows.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("me").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    rows = rows.join(first, "same", "left")
    key = lambda c: F.concat(F.when(c["id"] == (1 << 63) - 1, F.lit("null")).otherwise(c["id"].cast("string")), F.lit("."), c["row"].cast("string"))
    return rows.select("page_id", "url", "payload", "digest", key(F.col("me")).alias("key"), F.when(F.col("first") != F.col("me"), key(F.col("first"))).alias("origin"))


def records(found: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The text of the three records of each capture, one row a record."""
    urn = lambda kind, key: F.concat(F.lit(f"<urn:capture:{kind}:"), key, F.lit(">"))
    me = F.col("key")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    common = {"WARC-Target-URI": F.col("url"), "WARC-Date": F.lit(date)}
    tagged = {"WARC-Record-ID": urn("response", me), **common, "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest"))}
    http_type = {"Content-Type": F.lit("application/http; msgtype=response")}
    revisit = {"WARC-Refers-To": urn("response", F.col("origin")), "WARC-Profile": F.lit(REVISIT_PROFILE)}
    link = {"WARC-Concurrent-To": urn("response", me)}
    request = F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")), F.lit(END))
    return found.select(
        F.explode(
            F.array(
                _record("request", {"WARC-Record-ID": urn("request", me), **common, **link, "Content-Type": F.lit("application/http; msgtype=request")}, request),
                F.when(F.col("origin").isNull(), _record("response", tagged | http_type, F.concat(http, F.col("payload")))).otherwise(_record("revisit", tagged | revisit | http_type, http)),
                _record("metadata", {"WARC-Record-ID": urn("metadata", me), **common, **link, "Content-Type": F.lit("application/warc-fields")}, F.concat(F.lit("page-id: "), me)),
            )
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, records_per_file: int = 3000) -> None:
    records(captures(pages, min_payload)).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of an archive, in order.  The payload of a response or revisit is what follows the HTTP header."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, size = 0, len(data)
    while at < size:
        stop = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:stop].decode().split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            head[name] = value
        begin = stop + 4
        end = begin + int(head["Content-Length"])
        kind = head["WARC-Type"]
        payload = length = None
        if kind in ("response", "revisit"):
            cut = data.index(b"\r\n\r\n", begin) + 4
            for line in data[begin : cut - 4].split(b"\r\n"):
                if line.lower().startswith(b"content-length:"):
                    length = int(line.split(b":", 1)[1])
            payload = data[cut:end] if kind == "response" else None
        elif kind == "metadata":
            payload = data[begin:end]
        yield {
            "kind": kind,
            "record_id": head["WARC-Record-ID"],
            "concurrent_to": head.get("WARC-Concurrent-To"),
            "refers_to": head.get("WARC-Refers-To"),
            "target": head.get("WARC-Target-URI"),
            "date": head.get("WARC-Date"),
            "digest": head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
            "content_type": head.get("Content-Type"),
            "payload_length": length,
            "payload": payload,
        }
        at = end + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                rows, held = [], 0
                for row in parse_records(blob.as_py()):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


_ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD_SCHEMA.split(", ")])


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: record_id, response, request and metadata (structs; null where the archive has none).

    The records of a capture meet by the id of its response; nothing else is shuffled, and every capture has at most a few records.
    """
    fields = F.struct(*[c for c in found.columns])
    part = found.withColumn("capture", F.coalesce("concurrent_to", "record_id"))
    of = lambda *kinds: F.first(F.when(F.col("kind").isin(*kinds), fields), ignorenulls=True)
    return part.groupBy("capture").agg(of("response", "revisit").alias("response"), of("request").alias("request"), of("metadata").alias("metadata"))


@F.pandas_udf(T.StringType())
def _sha1_of(raw):
    return raw.map(lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode() if x is not None else None)


def page_digests(spark: SparkSession, pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Writes the pages as archives, reads them back and reports page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are computed from the payload read back; those of a revisit are its record's.
    """
    path = table_path(spark, "warc")
    write_archives(pages, path, min_payload)
    got = assemble(read_records(spark, path).withColumn("digest", F.when(F.col("kind") == "response", _sha1_of("payload")).otherwise(F.col("digest"))).withColumn("payload_length", F.when(F.col("kind") == "response", F.octet_length("payload")).otherwise(F.col("payload_length"))).withColumn("payload", F.when(F.col("kind") == "metadata", F.col("payload"))))
    number = lambda c: F.regexp_extract(c, r":(-?\d+)\.\d+>$", 1).try_cast("long")
    return got.select(
        number(F.col("capture")).alias("page_id"),
        F.col("response.payload_length").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        number(F.col("response.refers_to")).alias("refers_to"),
    )
