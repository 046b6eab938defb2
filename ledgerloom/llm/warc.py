"""WARC archives with a two-level capture index.

Writing: each page becomes one gzip member; equal payloads are found by SHA-1 with a map-side minimum, and all but the smallest
page_id become revisits. Each task writes archives of its own in the shared folder under names no other attempt uses, and
passes on (key, file, offset, length); that table is written before anything reads it, so a retried task leaves at most an
unreferenced file. Keys are reversed-host URL keys with the page's number, in an order that Spark's strings and Python's bytes share.

Index: keys are range-partitioned and sorted; each range becomes an index file of compressed blocks, each of block_lines
captures, and a sparse directory of the blocks' first keys at its end. Above it stands one row per index file (as many as partitions).

Reading: queries are sorted the same way; each is binary-searched among the files, in a file's directory and in its block, then
records are fetched by range reads in archive order. Folders are any that pyarrow's filesystems reach (s3a:// is read as s3://).

Defined results: null html is an empty payload, null url has the key ')'; null page_id sorts last and refers to nothing; rows that
repeat the smallest page_id of a payload are each a response; a very long payload is held whole by the task that writes or reads it; an
empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import new_folder, written
from ledgerloom.llm.workers import map_batches

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = "key string, file string, offset long, length long"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def url_key(url: str | None) -> str:
    """com,example,www:8080)/path?query of a URL: host reversed and lowered, scheme, user and fragment dropped."""
    if not url:
        return ")"
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    try:
        parts = urlsplit(clean)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){clean}"
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)}\t{(page_id if page_id is not None else (1 << 63)) + (1 << 63):020d}"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    value = name.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, response: bool, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit keeps the HTTP head, with the payload's length, and no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if response else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if not response:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(first)}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode_record(member: bytes) -> dict:
    """page_id, payload (None for a revisit), payload_bytes, payload_digest, record_type and refers_to; a wrong digest raises."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = next(int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].partition(":")[2]
    response = fields["WARC-Type"] == "response"
    if response and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _number(fields["WARC-Record-ID"]),
        "payload": body if response else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if response else _number(fields["WARC-Refers-To"]),
    }


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 1 << 30) -> DataFrame:
    """Archives in folder/archives and the table of their captures (key, file, offset, length)."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html)).alias("sha1"))
    firsts = written(rows.groupBy("sha1").agg(F.min("page_id").alias("first")), "payload-firsts")
    marked = rows.join(firsts, "sha1").select("page_id", "url", "html", "sha1", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(f"{folder}/archives")
        system.create_dir(path, recursive=True)
        out = name = None
        at = 0
        for batch in batches:
            entries = []
            for page_id, url, payload, sha1, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                member = encode_record(page_id, url, payload, base64.b32encode(sha1).decode(), first, page_id == first, date)
                out.write(member)
                entries.append((capture_key(url, page_id), name, at, len(member)))
                at += len(member)
            columns = list(zip(*entries, strict=True)) or [[]] * 4
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return written(map_batches(marked, run, _ENTRY), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = 1000) -> list[tuple[str, str, int, int]]:
    """Index files in folder/index; (first key, file, directory offset, directory length) of each, sorted: one per partition at most."""
    partitions = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "file", "offset"]
    ranged = captures.select(*order, "length").repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(f"{folder}/index")
        system.create_dir(path, recursive=True)
        directory, lines, at, out, name = [], [], 0, None, f"{uuid.uuid4().hex}.idx"

        def flush() -> int:
            block = zlib.compress("\n".join(lines).encode(), 6)
            directory.append((lines[0].rsplit("\t", 3)[0].encode(), at, len(block)))
            out.write(block)
            lines.clear()
            return at + len(block)

        for batch in batches:
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append("\t".join(map(str, entry)))
                if len(lines) == block_lines:
                    at = flush()
        if lines:
            at = flush()
        if not directory:
            return
        packed = zlib.compress(b"".join(struct.pack("<QII", o, n, len(k)) + k for k, o, n in directory), 6)
        out.write(packed)
        out.close()
        row = ([directory[0][0].decode()], [name], [at], [len(packed)])
        yield pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1]), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64())], ["key", "file", "offset", "length"])

    files = written(ranged.mapInArrow(run, _ENTRY), "index-files").collect()
    return sorted((f.key, f.file, f.offset, f.length) for f in files)


class IndexReader:
    """Finds captures by key; keeps the last directory and block, which sorted queries reuse."""

    def __init__(self, folder: str, files: list[tuple[str, str, int, int]]):
        self.system, self.path = _filesystem(f"{folder}/index")
        self.files, self.firsts = files, [f[0].encode() for f in files]
        self.at, self.directory, self.block_at, self.keys, self.entries = None, [], None, [], []

    def _read(self, file: str, offset: int, length: int) -> bytes:
        with self.system.open_input_file(f"{self.path}/{file}") as f:
            return zlib.decompress(f.read_at(length, offset))

    def _open(self, file: int) -> None:
        if self.at != file:
            data, self.directory, at = self._read(*self.files[file][1:]), [], 0
            while at < len(data):
                offset, length, n = struct.unpack_from("<QII", data, at)
                self.directory.append((data[at + 16 : at + 16 + n], offset, length))
                at += 16 + n
            self.at = file

    def _block(self, file: int, block: int) -> None:
        if self.block_at != (file, block):
            _, offset, length = self.directory[block]
            rows = [line.rsplit(b"\t", 3) for line in self._read(self.files[file][1], offset, length).split(b"\n")]
            self.keys = [r[0] for r in rows]
            self.entries = [(r[1].decode(), int(r[2]), int(r[3])) for r in rows]
            self.block_at = (file, block)

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(archive, offset, length) of every capture under a key."""
        wanted, found = key.encode(), []
        file = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while file < len(self.files) and self.firsts[file] <= wanted:
            self._open(file)
            block = max(0, bisect.bisect_left(self.directory, (wanted,)) - 1)
            while block < len(self.directory) and self.directory[block][0] <= wanted:
                self._block(file, block)
                low, high = bisect.bisect_left(self.keys, wanted), bisect.bisect_right(self.keys, wanted)
                found += self.entries[low:high]
                block += 1
            file += 1
        return found


def look_up(keys: DataFrame, folder: str, files: list[tuple[str, str, int, int]]) -> DataFrame:
    """The captures (key, file, offset, length) of a table of keys, each key once."""
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.select("key").distinct().repartitionByRange(partitions, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(folder, files)
        for batch in batches:
            found = [(key, *entry) for key in batch.column(0).to_pylist() for entry in reader.find(key)]
            columns = list(zip(*found, strict=True)) or [[]] * 4
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "file", "offset", "length"])

    return ranged.mapInArrow(run, _ENTRY)


def read_records(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records at captures, read by range in archive order; their payloads too if asked for."""
    partitions = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.select("file", "offset", "length").repartitionByRange(partitions, "file", "offset").sortWithinPartitions("file", "offset")
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("payload", pa.binary())] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(f"{folder}/archives")
        file, name = None, None
        for batch in batches:
            records = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    file, name = system.open_input_file(f"{path}/{archive}"), archive
                records.append(decode_record(file.read_at(length, offset)))
            yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in records], t) for f, t in fields], [f for f, _ in fields])
        if file is not None:
            file.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return map_batches(ranged, run, schema)


def page_keys(pages: DataFrame) -> DataFrame:
    """The capture key of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, i) for i, u in zip(ids, urls, strict=True)], pa.string())], ["key"])

    return pages.selectExpr("CAST(page_id AS long) AS page_id", "url").mapInArrow(run, "key string")


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Archives and index of all pages in a new shared folder, then every page read back through the index."""
    folder = new_folder(pages.sparkSession, "warc")
    files = write_index(write_archives(pages, folder), folder)
    return read_records(look_up(page_keys(pages), folder, files), folder, payloads)
