"""WARC archives as a table of chunks.

Writing: every task writes its records, each a gzip member of its own, to archives in the folder
all executors share, and returns what it wrote as rows. Those rows, stored by Spark, say which
archives count; what a lost or doubled task attempt has left is never read.

Reading: an archive is read as a stream of fixed blocks. Each record comes out as rows of
``record_id, chunk``, with the digest of the payload so far; no record is ever held whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunestrata.llm.common import written
from tunestrata.operators.joins import per_key
from tunestrata.session import shared_path

#: Payloads below this size are never written as a revisit.
LEAST_REVISIT = 100
CHUNK = 1 << 20
#: An archive is closed once it has this many bytes; its records are read by one task.
ARCHIVE = 256 << 20
#: Most tasks that read archives.
READERS = 50_000

_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_CHUNKS = pa.schema(
    [
        ("archive", pa.string()),
        ("record_no", pa.int64()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("refers_to_record", pa.string()),
        ("declared_digest", pa.string()),
        ("chunk", pa.int64()),
        ("size", pa.int64()),
        ("running_sha256", pa.string()),
        ("last", pa.bool_()),
        ("data", pa.binary()),
    ]
)
CHUNK_COLUMNS = (
    "archive string, record_no bigint, record_id string, record_type string, refers_to_record string, "
    "declared_digest string, chunk bigint, size bigint, running_sha256 string, last boolean, data binary"
)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The store behind a path: a plain path is a mounted folder, others go by their scheme."""
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def planned(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` for every page.

    Pages are grouped by digest alone, so payloads are not moved; the table that gives each
    digest's first page joins rows whose digest may be hot, which adaptive execution splits.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = (
        per_key(
            rows.where(F.length("payload") >= LEAST_REVISIT).select("page_id", "digest"),
            ["digest"],
            F.min("page_id").alias("first"),
            F.count(F.lit(1)).alias("n"),
        )
        .where("n > 1 and first is not null")
        .drop("n")
    )
    later = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    plan = rows.select("page_id", "digest").join(shared, "digest").select("page_id", "digest", later.alias("refers_to"))
    plan = per_key(plan.where("refers_to is not null"), ["page_id", "digest"], F.min("refers_to").alias("refers_to"))
    return rows.join(plan.hint("shuffle_hash"), ["page_id", "digest"], "left")


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None):
    """The parts of one record, in order."""
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%") if url else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    yield _header([*fields, ("Content-Length", str(len(_HTTP) + len(payload)))])
    yield _HTTP
    view = memoryview(payload)
    for start in range(0, len(view), CHUNK):
        yield view[start : start + CHUNK]
    yield b"\r\n\r\n"


def write_archives(plan: DataFrame, folder: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write ``page_id, url, payload, digest, refers_to`` rows; return the stored manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, name, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], schema=_MANIFEST)

        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(1, wbits=31)
                for part in _record(*(v.as_py() for v in row)):
                    out.write(packer.compress(part))
                out.write(packer.flush())
                size, records = out.tell(), records + 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = plan.select("page_id", "url", "payload", "digest", "refers_to")
    return written(rows.mapInArrow(write, "archive string, records bigint, bytes bigint"), "warc-manifest")


class _Members:
    """The bytes of a file of gzip members, a bounded piece at a time."""

    def __init__(self, stream):
        self.stream, self.unpacker, self.packed, self.held = stream, zlib.decompressobj(wbits=31), b"", b""

    def more(self) -> bool:
        """Take in another piece; false at the end of the file."""
        while True:
            if self.unpacker.eof:
                self.packed = self.unpacker.unused_data
                self.unpacker = zlib.decompressobj(wbits=31)
            if not self.packed:
                self.packed = self.stream.read(CHUNK)
                if not self.packed:
                    return False
            piece = self.unpacker.decompress(self.packed, CHUNK)
            # At the end of a member what is left is in unused_data alone.
            self.packed = b"" if self.unpacker.eof else self.unpacker.unconsumed_tail
            if piece:
                self.held += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to and with a mark."""
        looked = 0
        while (at := self.held.find(mark, looked)) < 0:
            looked = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        found, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return found

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in pieces of at most ``CHUNK``."""
        while size:
            want = min(size, CHUNK)
            while len(self.held) < want:
                if not self.more():
                    raise EOFError("an archive ends within a record")
            yield self.held[:want]
            self.held = self.held[want:]
            size -= want


def chunks_of(archive: str, stream, with_data: bool) -> Iterator[tuple]:
    """Rows of ``CHUNK_COLUMNS`` of one archive. A payload without bytes is one empty chunk."""
    members, record = _Members(stream), 0
    while (head := members.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)
        left = int(fields["Content-Length"])
        left -= len(members.until(b"\r\n\r\n"))  # the HTTP header before the payload
        digest, number = hashlib.sha256(), 0
        bare = [fields.get(n, "").strip("<>") for n in ("WARC-Record-ID", "WARC-Refers-To")]
        named = (archive, record, bare[0], fields["WARC-Type"], bare[1] or None, fields["WARC-Payload-Digest"].partition(":")[2])
        for piece in members.take(left) if left else (b"",):
            digest.update(piece)
            left -= len(piece)
            yield (*named, number, len(piece), digest.hexdigest(), left == 0, piece if with_data else None)
            number += 1
        for _ in members.take(4):
            pass
        record += 1


def read_chunks(manifest: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in a manifest: see ``CHUNK_COLUMNS``.

    There is a task for each archive, up to ``READERS``: left to itself, Spark would put the few
    bytes of the manifest, and with them all archives, into one task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for row in chunks_of(name, stream, with_data):
                        rows.append(row)
                        held += row[7] if with_data else 256
                        if held >= 8 * CHUNK:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    names = manifest.select("archive")
    names = names.repartition(max(1, min(names.count(), READERS)))
    return names.mapInArrow(read, CHUNK_COLUMNS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHUNKS, strict=True)], schema=_CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table: bytes, digest of the bytes, type, and what it refers to.

    A revisit has no payload of its own; it takes size and digest from the record it refers to,
    provided the digest is the one it declares.
    """
    whole = chunks.groupBy("archive", "record_no", "record_id", "record_type", "refers_to_record", "declared_digest").agg(
        F.sum("size").alias("payload_bytes"), F.max_by("running_sha256", "chunk").alias("payload_digest")
    )
    whole = written(whole, "warc-records")
    origin = per_key(
        whole.where("record_type = 'response'"),
        ["record_id"],
        F.first("payload_bytes").alias("origin_bytes"),
        F.first("payload_digest").alias("origin_digest"),
    ).withColumnRenamed("record_id", "refers_to_record")
    revisits = whole.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    same = F.when(F.col("origin_digest") == F.col("declared_digest"), F.struct("origin_bytes", "origin_digest"))
    revisits = revisits.join(origin, "refers_to_record", "left").withColumn("o", same).select(
        "record_id", "record_type", "refers_to_record",
        F.col("o.origin_bytes").alias("payload_bytes"), F.col("o.origin_digest").alias("payload_digest"),
    )
    checked = F.when(F.col("payload_digest") == F.col("declared_digest"), F.col("payload_digest"))
    return (
        whole.where("record_type = 'response'")
        .select("record_id", "record_type", "refers_to_record", "payload_bytes", checked.alias("payload_digest"))
        .union(revisits.select("record_id", "record_type", "refers_to_record", "payload_bytes", "payload_digest"))
    )


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write every page, read the archives back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``.

    A null html is an empty payload; a null url becomes a URN. A page without an id is written
    as a response with an empty id and comes back with a null one. Repeated rows are written and come
    back as often as they occur; of those with equal html the id alone is compared. A digest that does not
    match its bytes comes back null. An empty table gives an empty result.
    """
    folder = shared_path(spark, "warc")
    manifest = write_archives(planned(pages), folder)
    found = records(read_chunks(manifest, folder, with_data=False))
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    return found.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to_record").alias("refers_to"),
    )
