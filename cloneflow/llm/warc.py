"""WARC archives as chunked record tables.

A payload is cut into rows of bounded size before it leaves the scan, and a writer or reader task never holds more than one
chunk of a record: headers need only length and digest, which are columns; digests are carried from chunk to chunk. An
archive is a folder of gzip members, one per record, and a manifest table of segments. The manifest is written
when all writers have ended, so files of failed attempts are never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneflow.operators.joins import BROADCAST_BYTES, join_unique
from cloneflow.session import fresh_path, materialize

MIN_REVISIT_BYTES = 100
CHUNK_BYTES = 1 << 20
SEGMENT_BYTES = 64 << 20
FILE_BYTES = 1 << 30
READ_BYTES = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

RECORDS = "path string, start long, stop long, records long"
CHUNKS = (
    "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no long, last boolean, chunk binary, "
    "bytes_so_far long, digest_so_far string, payload_bytes long, payload_digest string, intact boolean"
)
CHUNK_TYPE = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("chunk_no", pa.int64()),
        ("last", pa.bool_()),
        ("chunk", pa.binary()),
        ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("intact", pa.bool_()),
    ]
)


def digested(pages: DataFrame, payload: str = "html") -> DataFrame:
    """`page_id, url, payload, payload_bytes, payload_digest`; a null payload is empty."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return pages.select("page_id", "url", body.alias("payload"), F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))


def assign_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`record_type` and `refers_to` beside each digested page.

    Only digests that occur more than once are joined back, so pages are not shuffled as long as these fit a broadcast;
    beyond it, a digest that many pages share is salted.
    """
    digests = pages.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(digests.where((F.col("n") > 1) & F.col("first_id").isNotNull()).drop("n"), "repeated_payloads")
    joined = join_unique(pages, repeated, ["payload_digest"], ["page_id"], how="left", broadcast_bytes=broadcast_bytes)
    again = F.col("first_id").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    again &= F.col("page_id").isNotNull()
    return joined.withColumns(
        {"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first_id"))}
    ).drop("first_id")


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row per chunk, in order: a revisit has one empty chunk, a response ceil(bytes / chunk_bytes), at least one."""
    stored = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    last = F.greatest(F.ceil(F.octet_length("payload") / F.lit(chunk_bytes)).cast("int") - 1, F.lit(0))
    rows = records.withColumn("payload", stored).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    cut: Column = F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return rows.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", cut.alias("chunk"))


def _name(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def _head(row: dict) -> bytes:
    """The record's header, and for a response the HTTP header that its payload follows."""
    http = HTTP % row["payload_bytes"]
    revisit = row["record_type"] == "revisit"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or _name(row["page_id"]))
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{_name(row['page_id'])}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <{_name(row['refers_to'])}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _writer(folder: str, segment_bytes: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, files, out, pack = TaskContext.get(), 0, None, None
        segments: list[tuple[str, int, int, int]] = []
        path, start, count = "", 0, 0

        def end_segment():
            nonlocal start, count
            if count:
                segments.append((path, start, out.tell(), count))
            start, count = out.tell(), 0

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is None or out.tell() >= file_bytes:
                        if out is not None:
                            end_segment()
                            out.close()
                        # The attempt is part of the name: a repeated or speculative task never writes into another's file.
                        path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{files:03d}.warc.gz"
                        out = store.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}", compression=None)
                        files, start = files + 1, 0
                    elif out.tell() - start >= segment_bytes:
                        end_segment()
                    pack = zlib.compressobj(wbits=31)
                    out.write(pack.compress(_head(row)))
                    left = 0 if row["record_type"] == "revisit" else row["payload_bytes"]
                out.write(pack.compress(row["chunk"]))
                left -= len(row["chunk"])
                if not left:
                    out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    count += 1
        if out is not None:
            end_segment()
            out.close()
        columns = list(zip(*segments, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "start", "stop", "records"])

    return run


def write_archive(
    records: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write the records and return the manifest, `path, start, stop, records`: one row per segment of whole records.

    `folder` is a URI that every executor reaches; the default lies in the shared folder. `records` has the columns of
    `assign_types`. The chunks of a record follow each other in one task, as `explode` keeps their order.
    """
    spark = records.sparkSession
    folder = folder or fresh_path(spark, "warc")
    folder = folder if re.match(r"\w+:", folder) else f"file://{folder}"
    folder = re.sub(r"^file:/+", "file:///", folder)
    return materialize(chunked(records, chunk_bytes).mapInArrow(_writer(folder, segment_bytes, file_bytes), RECORDS), "warc_manifest")


class _Member:
    """The bytes of one segment, read and inflated piece by piece."""

    def __init__(self, stream, size: int):
        self.stream, self.left, self.packed = stream, size, b""
        self.inflate, self.data = zlib.decompressobj(wbits=31), b""

    def more(self) -> bool:
        """Adds up to READ_BYTES of plain bytes to `data`. False when the segment is over."""
        while True:
            if self.inflate.eof:
                self.packed = self.inflate.unused_data or self.packed
                self.inflate = zlib.decompressobj(wbits=31)
            if not self.packed:
                if not self.left:
                    return False
                self.packed = self.stream.read(min(READ_BYTES, self.left))
                if not self.packed:
                    raise EOFError("the archive ends inside a segment")
                self.left -= len(self.packed)
            plain = self.inflate.decompress(self.packed, READ_BYTES)
            self.packed = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.packed = self.inflate.unused_data
                self.inflate = zlib.decompressobj(wbits=31)
            if plain:
                self.data += plain
                return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before `mark`, which is passed over. None at the end."""
        while (at := self.data.find(mark)) < 0:
            if not self.more():
                if self.data:
                    raise EOFError("a record has no end")
                return None
        found, self.data = self.data[:at], self.data[at + len(mark) :]
        return found

    def take(self, most: int) -> bytes:
        """At most `most` bytes, as many as are there."""
        if not self.data and most and not self.more():
            raise EOFError("a record has no end")
        found, self.data = self.data[:most], self.data[most:]
        return found


def _records(member: _Member, chunk_bytes: int) -> Iterator[dict]:
    number = lambda name: None if name in ("", "null") else int(name)
    while (head := member.until(b"\r\n\r\n")) is not None:
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        left = int(fields["Content-Length"])
        http = member.until(b"\r\n\r\n")
        left -= len(http) + 4
        kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
        name = fields["WARC-Record-ID"].strip("<>")
        row = {
            "record_id": name,
            "page_id": number(name.removeprefix("urn:page:")),
            "url": fields["WARC-Target-URI"],
            "record_type": kind,
            "refers_to": number(fields.get("WARC-Refers-To", "").strip("<>").removeprefix("urn:page:")),
            "payload_bytes": int(fields["X-Payload-Length"]),
            "payload_digest": said,
        }
        digest, size, chunk_no = hashlib.sha256(), 0, 0
        while True:
            parts, got = [], 0
            while left and got < chunk_bytes:
                parts.append(piece := member.take(min(left, chunk_bytes - got)))
                got, left = got + len(piece), left - len(piece)
            chunk = b"".join(parts)
            digest.update(chunk)
            size += len(chunk)
            so_far = digest.hexdigest()
            intact = kind == "revisit" or so_far == said and size == row["payload_bytes"]
            yield row | {"chunk_no": chunk_no, "last": not left, "chunk": chunk, "bytes_so_far": size, "digest_so_far": so_far, "intact": intact if not left else None}
            chunk_no += 1
            if not left:
                break
        if member.until(b"\r\n\r\n") != b"":
            raise ValueError(f"{name}: its block is longer than it says")


def _reader(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(segment["path"])
                with store.open_input_file(path) as stream:
                    stream.seek(segment["start"])
                    rows, size = [], 0
                    for row in _records(_Member(stream, segment["stop"] - segment["start"]), chunk_bytes):
                        rows.append(row)
                        size += len(row["chunk"])
                        if size >= 8 * chunk_bytes or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, CHUNK_TYPE)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, CHUNK_TYPE)

    return run


def read_archive(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table: `record_id, chunk_no, chunk` and what the headers say, with length and digest up to each chunk.

    `last` marks the end of a record; there, `intact` tells whether the payload matches its header. A revisit has no payload of its
    own and takes length and digest from its header.
    """
    segments = max(1, manifest.count())
    return manifest.repartition(segments, "path", "start").mapInArrow(_reader(chunk_bytes), CHUNKS)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Every row of `pages` (page_id, url, html) written as a WARC record and read back: a row per page.

    A null html is an empty payload, a null url is replaced by the page's own name, a null page_id is always a response and no
    revisit's target. Rows that repeat the smallest page_id of a payload are all responses. Empty input: no rows.
    """
    manifest = write_archive(assign_types(digested(pages)))
    ends = read_archive(manifest).where("last")
    failed = F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id")))
    digest = F.when(F.col("intact"), F.col("payload_digest")).otherwise(failed)
    return ends.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
