"""WARC archives: write pages as gzip members, read them back in splits.

Writing: each task puts its records into one archive in shared storage, a gzip member for each record. Of records with
equal payloads of at least `least_bytes` bytes, the one with the smallest page_id is a response and the others refer to
it. Only the archives of tasks that succeeded are in the manifest, so retried tasks leave nothing that is read.

Reading: an archive is cut into byte ranges. A task scans its range for the gzip magic, validates a candidate by
decoding the start of the member (it must be a WARC header), and owns the records that start inside its range; it reads
past the end of the range to finish the last one.

A null payload is empty; a null page_id or url leaves its header out. A page without page_id refers to the smallest
page_id of its group; equal rows with the smallest page_id are all responses. Line breaks in a url are percent-encoded.
Payloads are told apart by their SHA-256. A payload is processed whole; it may be larger than a split.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import column, scratch, stored

LEAST_BYTES = 100
SPLIT_BYTES = 8 << 20
#: Beyond so many splits, a task reads several one after the other.
MOST_TASKS = 100_000
DATE = "2024-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_HEADER_BYTES = 8192
_STEP = 1 << 18


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    if "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: an HTTP response, or a revisit that has the response's headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = hashlib.md5(f"{page_id} {url} {digest}".encode()).hexdigest()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(name)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers of a record by lower-case name, with `payload` (None for a revisit) and the payload's full length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        headers[name.lower()] = value
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [line.split(b": ")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: ")]
    return headers | {"payload": payload if headers["warc-type"] == "response" else None, "length": int(lengths[0])}


def _member(raw: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _writer(folder: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _filesystem(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, records, size = None, 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (batch.column(i)[row].as_py() for i in range(5))
                if out is None:
                    files.create_dir(place, recursive=True)
                    out = files.open_output_stream(f"{place}/{name}", compression=None)
                size += out.write(_member(record(page_id, url, (html or "").encode(), digest, refers_to), level))
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [records]})

    return write


def write_archives(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    folder: str | None = None,
    least_bytes: int = LEAST_BYTES,
    level: int = 6,
) -> DataFrame:
    """Write the pages; returns the manifest: path, bytes and records of each archive."""
    body = F.coalesce(column(html), F.lit(""))
    rows = pages.select(
        column(page_id).cast("bigint").alias("page_id"),
        column(url).alias("url"),
        column(html).alias("html"),
        F.sha2(body.cast("binary"), 256).alias("digest"),
    )
    firsts = (
        rows.where(F.octet_length("html") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    refers = F.when(F.coalesce(F.col("page_id") > F.col("first"), F.col("first").isNotNull()), F.col("first"))
    typed = rows.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    where = folder or scratch(pages.sparkSession, "warc")
    return stored(typed.mapInArrow(_writer(where, level), "path string, bytes bigint, records bigint"), "manifest")


class _Archive:
    """Bytes of an archive by position, read in steps."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""

    def at(self, position: int, least: int) -> bytes:
        """Bytes from `position`, at least so many unless the archive ends."""
        if not self.start <= position or position + least > self.start + len(self.held):
            if position + least > self.size:
                least = self.size - position
            if not self.start <= position or position + least > self.start + len(self.held):
                self.start = position
                self.held = self.file.read_at(min(max(least, _STEP), self.size - position), position)
        return self.held[position - self.start :]


def _is_record(archive: _Archive, position: int) -> bool:
    try:
        start = zlib.decompressobj(31).decompress(archive.at(position, _HEADER_BYTES), 64)
    except zlib.error:
        return False
    return start.startswith(b"WARC/1.")


def records_in(archive: _Archive, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(position, decoded bytes) of the records that start in [start, stop)."""
    position = start
    while position < stop:
        held = archive.at(position, 3)
        found = held.find(_MAGIC)
        if found < 0:
            position += max(len(held) - 2, 1)
            continue
        position += found
        if position >= stop:
            return
        if not _is_record(archive, position):
            position += 1
            continue
        unpacker, parts, end = zlib.decompressobj(31), [], position
        while not unpacker.eof and end < archive.size:
            some = archive.at(end, 1)
            parts.append(unpacker.decompress(some))
            end += len(some) - len(unpacker.unused_data)
        if not unpacker.eof:
            raise ValueError(f"the record at byte {position} is cut off")
        yield position, b"".join(parts)
        position = end


def _reader(payloads: bool):
    fields = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("page_id", pa.int64()),
                ("url", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.int64()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                *([("payload", pa.binary())] if payloads else []),
            ]
        )
        number = lambda v: None if v is None else int(v)
        for batch in batches:
            for split in batch.to_pylist():
                files, path = _filesystem(split["path"])
                rows, held = [], 0
                with files.open_input_file(path) as file:
                    for position, raw in records_in(_Archive(file, split["bytes"]), split["start"], split["stop"]):
                        r = parse(raw)
                        digest = r["warc-payload-digest"].partition(":")[2]
                        if r["payload"] is not None and hashlib.sha256(r["payload"]).hexdigest() != digest:
                            raise ValueError(f"{path}: the payload at byte {position} does not have its digest")
                        values = (
                            number(r.get("x-page-id")),
                            r.get("warc-target-uri"),
                            r["warc-type"],
                            number(r.get("x-refers-to-page-id")),
                            r["length"],
                            digest,
                        )
                        rows.append(dict(zip(fields, values, strict=True)) | ({"payload": r["payload"]} if payloads else {}))
                        held += len(raw)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of archives (path, bytes): page_id, url, record_type, refers_to, payload_bytes, payload_digest.

    `payloads` adds the payload, which is null for revisits.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes)))
    splits = manifest.select("path", "bytes", starts.alias("start")).withColumn(
        "stop", F.least(F.col("start") + split_bytes, "bytes")
    )
    schema = (
        "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
    )
    # A split is a row of a few bytes: without a number of its own, adaptive execution would read them all in one task.
    found = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return splits.repartition(min(int(found), MOST_TASKS), "path", "start").mapInArrow(
        _reader(payloads), schema + (", payload binary" if payloads else "")
    )


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write the pages, then read the archives back."""
    return read_archives(write_archives(pages, **options), payloads=False)
