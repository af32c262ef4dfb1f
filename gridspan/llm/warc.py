"""WARC archives compressed record by record with a dictionary of their own.

An archive is a Zstandard file: a skippable frame with the dictionary, built
from records of this archive, then one frame for each record. Any record can be
read alone once the dictionary is. Archives are rows of a table, each with the
whole file's bytes, so Spark's own committer makes writing safe against lost
tasks and any file system that Spark writes will do; `export` turns them into
files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import doc_key, meet, small_batches, stash, tidy

#: Bytes of payload in an archive, of its dictionary, of the records that the dictionary is built from, and read at a time.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, READ_BYTES = 32 << 20, 64 << 10, 1 << 20, 8 << 10
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record. A revisit has the HTTP header, which tells the payload's length, but no payload. Its id has page_id and digest, as page_ids may repeat."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}:{digest}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary of evenly spread records; of too few to train one, their plain content.

    Of a long record a piece is taken, from one place in one record and from another in the next.
    """
    step, piece = max(1, sum(map(len, records)) // SAMPLE_BYTES), 32768
    samples = []
    for n, r in enumerate(records[::step]):
        at = n * 7919 * piece % max(len(r) - piece, 1)
        samples.append(r[at : at + piece])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    trained = dictionary(records)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=_load(trained), write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(trained)), trained, *map(compressor.compress, records)])


def _load(trained: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if trained[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(trained, dict_type=kind)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    view = memoryview(data)
    magic, size = struct.unpack_from("<II", view)
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    decompressor, at = zstandard.ZstdDecompressor(dict_data=_load(bytes(view[8 : 8 + size]))), 8 + size
    while at < len(view):
        # What follows a frame comes back as unused, so frames are fed in steps: the whole archive each time would take quadratic time.
        one, parts = decompressor.decompressobj(), []
        while not one.eof and at < len(view):
            parts.append(one.decompress(view[at : at + READ_BYTES]))
            at = min(at + READ_BYTES, len(view))
        if not one.eof:
            raise ValueError("the archive ends within a record")
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: None if x.startswith("<urn:page:None:") else int(x[10:-1].split(":")[0])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        length = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
        return number(fields["WARC-Record-ID"]), length, digest, "revisit", number(fields["WARC-Refers-To"])
    if base32_sha1(payload) != digest:
        raise ValueError("a payload differs from its digest")
    return number(fields["WARC-Record-ID"]), len(payload), digest, "response", None


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def archive() -> pa.RecordBatch:
        name = f"pages-{task:06d}-{number:05d}.warc.zst"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([write_archive(held)], pa.binary())], ["archive", "records", "data"])

    for batch in batches:
        for page, url, html, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(record(page, url, html or b"", first, revisit))
            size += len(html or b"")
            if size >= ARCHIVE_BYTES:
                yield archive()
                number, held, size = number + 1, [], 0
    if held:
        yield archive()


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive, records, data): the archives of all rows of `pages`, written to the shared folder.

    Of records with equal payloads of at least `min_bytes` bytes, that with the
    smallest page_id is a response and the others revisit it; a null id counts
    as smallest, rows that share the smallest id are all responses. A null html
    is an empty payload; a null url leaves the target out.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), doc_key("page_id").alias("k"), F.unhex(F.sha1(html)).alias("digest"))
    groups = rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n"))
    copies = stash(groups.filter("first < last"), "copies")
    later = meet(rows.select("k", "digest"), copies, ["digest"]).filter("k > first").select("k", "digest", "first").distinct()
    marked = rows.join(later, ["k", "digest"], "left")
    null_id = F.col("first") == F.lit(-(1 << 63))
    told = marked.select("page_id", "url", "html", F.when(~null_id, F.col("first")).alias("first"), F.col("first").isNotNull().alias("revisit"))
    return stash(told.mapInArrow(tidy(_write), "archive string, records long, data binary"), "archives")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for data in batch.column(0):
            found = [parse(r) for r in read_archive(data.as_buffer())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read back."""
    return archives.select("data").mapInArrow(tidy(_read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(archives: DataFrame, folder: str) -> None:
    """The archives as files of a folder that the driver can write, one at a time."""
    import pathlib

    for row in archives.toLocalIterator():
        (pathlib.Path(folder) / row.archive).write_bytes(row.data)
