"""WARC archives as a chunked record table.

Writing: each row becomes a WARC/1.1 record, one gzip member each.  Rows with equal payloads (SHA-1) have one response
record, that of the largest id; the others are revisit records that refer to it and hold the HTTP header only.  The table
is cut into chunks by Spark before Python sees it, so a writer holds one chunk of a payload, never the whole.

Reading: the archives come back as rows ``(record, chunk, at, size, data, sha1, last)``.  A reader inflates a bounded number of
bytes at a time and emits a chunk at a time, with the SHA-1 of all the record's bytes up to the chunk's end; the row with
``last`` has the digest of the record.  Archives are files of the shared folder under names that each task attempt makes
for itself; only those of successful attempts are listed, so lost executors and repeated tasks do no harm.

A null payload counts as empty.  A null id is written as ``null`` and never is a response while the same payload has
another id.  Rows that repeat both id and payload get a record each, of the same type.  Null URLs are left out of the
header.  A very long payload crosses in chunks of ``CHUNK_BYTES``.  An empty table makes no archive and no rows.  Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import open_fs
from . import common

CHUNK_BYTES = 1 << 16
ARCHIVE_BYTES = 64 << 20
SHARED_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_CHUNKS = "record string, type string, refers_to string, uri string, payload_length long, declared_digest string, chunk int, at long, size int, data binary, sha1 string, last boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


# ---------------------------------------------------------------- which record refers to which

def record_types(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """``pages`` as ``id, uri, payload, digest, type, refers_to``; equal payloads of fewer bytes are all responses.

    The digest groups are narrow rows, counted before the shuffle; the wide payloads are shuffled once, by id and digest,
    which no group of equal payloads makes uneven.
    """
    rows = pages.select(F.col(id_col).alias("id"), "uri", F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    narrow = rows.where(F.octet_length("payload") >= least_bytes).select("id", "digest")
    groups = narrow.groupBy("digest").agg(F.max("id").alias("newest"), F.count("*").alias("n")).where("n > 1")
    revisits = narrow.join(groups, "digest").where(~F.col("id").eqNullSafe(F.col("newest")))
    revisits = revisits.select(F.col("id").alias("own_id"), F.col("digest").alias("own_digest"), F.col("newest").alias("refers_to")).distinct()
    out = rows.join(revisits, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    return out.select("id", "uri", "payload", "digest", kind.alias("type"), "refers_to")


# ---------------------------------------------------------------- writing

def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def header(record: str, kind: str, uri: str | None, refers_to: str | None, digest: str, length: int) -> bytes:
    """The WARC header, the HTTP header and nothing of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {SHARED_PAYLOAD}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = len(http.encode()) + (length if kind == "response" else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode("utf-8", "replace")


class ArchiveWriter:
    """Appends records to archives of bounded size."""

    def __init__(self, folder: str, most: int = ARCHIVE_BYTES, level: int = 1):
        self.fs, self.folder = open_fs(folder)
        self.most, self.level = most, level
        self.done: list[tuple[str, int, int]] = []
        self.out = None

    def begin(self, head: bytes) -> None:
        if self.out is None or self.size > self.most:
            self.close()
            self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            self.out, self.size, self.records = self.fs.open_output_stream(self.name, compression=None), 0, 0
        self.records += 1
        self.member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.append(head)

    def append(self, data) -> None:
        self._put(self.member.compress(data))

    def end(self) -> None:
        self._put(self.member.compress(b"\r\n\r\n") + self.member.flush())

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.size))
            self.out = None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` to WARC archives under ``folder``; the written list of archives ``(path, records, bytes)``."""
    spark = pages.sparkSession
    common.workers_can_import(spark)
    open_fs(folder)[0].create_dir(open_fs(folder)[1])
    scheme = re.match(r"^(\w+://[^/]*)?", folder)[0]
    rows = record_types(pages.select(F.col(id_col), F.col(url_col).cast("string").alias("uri"), F.col(payload_col)), id_col, payload_col, least_bytes)
    length = F.octet_length("payload").cast("long")
    rows = rows.withColumn("length", length).withColumn("kept", F.when(F.col("type") == "response", F.col("payload")).otherwise(F.lit(b"")))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.octet_length("kept") - 1, F.lit(0)).cast("long"), F.lit(chunk_bytes).cast("long"))
    chunks = rows.select("*", F.explode(starts).alias("at")).select(
        F.when(F.col("at") == 0, F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("record"), F.when(F.col("at") == 0, F.col("uri")).alias("uri"), "type", "refers_to", "digest", "length", F.substring("kept", F.col("at").cast("int") + 1, F.lit(chunk_bytes)).alias("data")
    ).withColumn("refers_to", F.col("refers_to").cast("string"))

    @common.lean
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, inside = ArchiveWriter(folder), False
        for batch in batches:
            data = batch.column("data")
            meta = batch.select(["record", "uri", "type", "refers_to", "digest", "length"]).to_pylist()
            for i, m in enumerate(meta):
                if m["record"] is not None:
                    if inside:
                        writer.end()
                    writer.begin(header(m["record"], m["type"], m["uri"], m["refers_to"], base32(m["digest"]), m["length"]))
                    inside = True
                writer.append(memoryview(data[i].as_buffer()))
        if inside:
            writer.end()
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array([scheme + n for n, _, _ in writer.done]), pa.array([r for _, r, _ in writer.done], pa.int64()), pa.array([b for _, _, b in writer.done], pa.int64())], ["path", "records", "bytes"])

    return common.written(chunks.mapInArrow(write, "path string, records long, bytes long"), "archives")


# ---------------------------------------------------------------- reading

def inflated(stream, block: int) -> Iterator[bytes]:
    """The bytes of a file of gzip members, ``block`` at most at a time."""
    inflater, pending = zlib.decompressobj(31), b""
    while True:
        if not pending:
            pending = stream.read(block)
            if not pending:
                return
        if inflater.eof:
            inflater = zlib.decompressobj(31)
        out = inflater.decompress(pending, block)
        pending = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
        if out:
            yield out


class RecordReader:
    """Parses records from bytes that come in any pieces; holds one piece and one header."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def _head(self) -> bytes | None:
        while b"\r\n\r\n" not in self.held:
            if not self._more():
                return None
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        return head

    def _take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        if len(out) < n:
            raise ValueError("the archive ends inside a record")
        return out

    def chunks(self, chunk_bytes: int) -> Iterator[tuple]:
        while (head := self._head()) is not None:
            lines = head.decode("utf-8", "replace").split("\r\n")
            fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            left = int(fields["content-length"])
            http = self._head()
            left -= len(http) + 4
            entity = int(re.search(rb"Content-Length: (\d+)", http)[1])
            name = lambda k: re.sub(r"^<urn:page:(.*)>$", r"\1", fields[k]) if k in fields else None
            own = (name("warc-record-id"), fields["warc-type"], name("warc-refers-to"), fields.get("warc-target-uri"), entity, fields["warc-payload-digest"].removeprefix("sha1:"))
            digest, at, number = hashlib.sha1(), 0, 0
            while True:
                data = self._take(min(chunk_bytes, left))
                digest.update(data)
                left -= len(data)
                yield (*own, number, at, len(data), data, base32(digest.digest()), left == 0)
                at += len(data)
                number += 1
                if not left:
                    break
            self._take(4)


def read_archives(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk rows of the listed archives; ``with_data`` false leaves the bytes in the reader."""
    spark = archives.sparkSession
    common.workers_can_import(spark)
    schema = StructType.fromDDL(_CHUNKS)
    names = schema.fieldNames()
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    @common.lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inner = open_fs(path)
                rows, held = [], 0
                with fs.open_input_stream(inner, compression=None) as stream:
                    for row in RecordReader(inflated(stream, chunk_bytes)).chunks(chunk_bytes):
                        rows.append(row if with_data else (*row[:9], None, *row[10:]))
                        held += row[8] + 200
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    count = max(1, archives.count())
    return archives.select("path").repartition(min(count, 100_000)).mapInArrow(read, schema)


def records(chunks: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per record, from its last chunk: ids, type, length and digest of the full payload.

    A response has the length and digest that were read; a revisit has those of the payload that it refers to.  A
    response whose bytes do not have the digest in its header is an error.
    """
    last = chunks.where("last")
    response = F.col("type") == "response"
    checked = F.when(response & (F.col("sha1") != F.col("declared_digest")), F.raise_error(F.lit("a payload does not have its digest"))).otherwise(F.col("declared_digest"))
    as_id = lambda c: F.when(F.col(c) != "null", F.col(c).cast(id_type))
    return last.select(as_id("record").alias("page_id"), F.when(response, F.col("at") + F.col("size")).otherwise(F.col("payload_length")).alias("payload_bytes"), checked.alias("payload_digest"), F.col("type").alias("record_type"), as_id("refers_to").alias("refers_to"))


def write_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all rows of ``pages`` to archives in the shared folder, and read their records back."""
    archives = write_archives(pages, common.new_path(spark, "warc"))
    return records(read_archives(archives, with_data=False), pages.schema["page_id"].dataType.simpleString())
