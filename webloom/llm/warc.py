"""WARC archives: a writer, and a sequential reader (operator 9).

A record is a gzip member of its own.  The reader inflates a file in small steps,
takes as many bytes as Content-Length says, and checks the digests that a record has.
It reads archives of others as well: all types of records, any identifiers, digests
or none, and bodies in chunks.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import Any, BinaryIO
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import shared_path, spool, utf8

#: Archives are closed at this size.
ARCHIVE_BYTES = 64 << 20
STEP = 1 << 16
#: Longest header of a record or of its HTTP message.
HEADER_BYTES = 1 << 20
#: Copies of the table of frequent payloads, so that rows with one payload go to as many tasks.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_shared(path: str, mode: str) -> BinaryIO:
    """A file by URI: local ones by the operating system, others by Arrow."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        name = unquote(parts.path)
        if "w" in mode:
            os.makedirs(os.path.dirname(name), exist_ok=True)
        return open(name, mode)
    system, name = _filesystem(path)
    if "w" in mode:
        system.create_dir(os.path.dirname(name), recursive=True)
        return system.open_output_stream(name)
    return system.open_input_stream(name)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_of(page_id: int | None, url: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url or '')}>"


def id_of(name: str | None) -> int | None:
    """The page that this module's writer named; null for identifiers of others."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", name or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name_of(page_id, target)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[5:5] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to, '')}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class Damaged(ValueError):
    """An archive isn't framed as it should be, or a digest doesn't agree."""


class Inflated:
    """The content of gzip members, one after the other, a step at a time."""

    def __init__(self, file: BinaryIO, step: int = STEP) -> None:
        self.file, self.step = file, step
        self.raw, self.ready, self.unpack = b"", b"", zlib.decompressobj(31)

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the file."""
        self.raw = self.raw or self.file.read(self.step)
        self.unpack, self.ready = zlib.decompressobj(31), b""
        return bool(self.raw)

    def read(self, most: int) -> bytes:
        """At least one byte and at most `most`; none at the end of the member."""
        while not self.ready and not self.unpack.eof:
            try:
                self.ready = self.unpack.decompress(self.raw, 4 * self.step)
            except zlib.error as error:
                raise Damaged(f"not a gzip member: {error}") from error
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if not self.ready and not self.unpack.eof and not self.raw:
                self.raw = self.file.read(self.step)
                if not self.raw:
                    raise Damaged("the last member is cut short")
        out, self.ready = self.ready[:most], self.ready[most:]
        return out

    def header(self) -> bytes:
        """What stands before the first empty line."""
        head = b""
        while (end := head.find(b"\r\n\r\n")) < 0:
            more = self.read(self.step)
            if not more or len(head) > HEADER_BYTES:
                raise Damaged("a header doesn't end")
            head += more
        self.ready = head[end + 4 :] + self.ready
        return head[:end]

    def exactly(self, size: int) -> Iterator[bytes]:
        """As many bytes, in parts."""
        while size:
            part = self.read(min(size, self.step))
            if not part:
                raise Damaged("Content-Length doesn't agree with the member")
            size -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by name in small letters; the first line under the empty name. Folded lines go on."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}


def _agrees(stated: str, found: dict[str, Any]) -> bool:
    """Whether a digest such as sha1:ABC (base 32 or 16) is that of what was hashed; True for an unknown algorithm."""
    name, _, value = stated.partition(":")
    name = name.lower().replace("-", "")
    if name not in found:
        return True
    raw = found[name].digest()
    return value.upper().rstrip("=") in (base64.b32encode(raw).decode().rstrip("="), raw.hex().upper())


class _Hashed:
    """Hashes by the algorithms that digests name."""

    def __init__(self, *stated: str | None) -> None:
        names = {"sha1"} | {x.partition(":")[0].lower().replace("-", "") for x in stated if x}
        self.by = {n: hashlib.new(n) for n in names if n in ("sha1", "md5", "sha256", "sha512")}
        self.size = 0

    def update(self, part: bytes) -> bytes:
        self.size += len(part)
        for h in self.by.values():
            h.update(part)
        return part


def unchunked(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a body in chunks, as it comes."""
    held, left, body = b"", 0, False
    for part in parts:
        held += part
        while held:
            if body:
                out, held = held[:left], held[left:]
                left -= len(out)
                body = left > 0
                if out:
                    yield out
                continue
            line, gap, rest = held.partition(b"\r\n")
            if not gap:
                if len(held) > HEADER_BYTES:
                    raise Damaged("the size of a chunk doesn't end")
                break
            held = rest
            if line:  # an empty one ends the chunk before
                try:
                    left = int(line.split(b";")[0], 16)
                except ValueError as error:
                    raise Damaged("a chunk has no size") from error
                if not left:  # trailers are left out
                    for _ in parts:
                        pass
                    return
                body = True
    if body:
        raise Damaged("a chunk is cut short")


def read_records(file: BinaryIO, keep: bool = True, step: int = STEP) -> Iterator[dict]:
    """The records of an archive; what is held of one is its payload, if it is kept, else a step.

    Framing is checked, and so are digests where a record has them.  The payload is the body of the HTTP message,
    without chunks, or the block where it is no such message; a digest may be that of the body with its chunks.
    """
    source = Inflated(file, step)
    while source.next_member():
        head = _fields(source.header())
        if not head[""].startswith("WARC/") or not head.get("content-length", "").isdigit():
            raise Damaged(f"not a record: {head['']!r}")
        yield _record(head, source, keep)
        if b"".join(iter(lambda: source.read(step), b"")) != b"\r\n\r\n":
            raise Damaged("Content-Length doesn't agree with the member")


def _record(head: dict[str, str], source: Inflated, keep: bool) -> dict:
    kind, stated = head.get("warc-type", ""), head.get("warc-payload-digest")
    block, sent, whole = _Hashed(head.get("warc-block-digest")), _Hashed(stated), _Hashed(stated)
    parts = map(block.update, source.exactly(int(head["content-length"])))
    http: dict[str, str] = {}
    if kind in ("response", "request", "revisit") and head.get("content-type", "").lower().startswith("application/http"):
        begun = b""
        for part in parts:
            begun += part
            if b"\r\n\r\n" in begun:
                break
            if len(begun) > HEADER_BYTES:
                raise Damaged("a header doesn't end")
        first, _, rest = begun.partition(b"\r\n\r\n")
        http, parts = _fields(first), chain([rest], parts)
    body = map(sent.update, parts)
    chunks = "chunked" in http.get("transfer-encoding", "").lower()
    kept = []
    for part in unchunked(body) if chunks else body:
        whole.update(part)
        if keep:
            kept.append(part)
    if not _agrees(head.get("warc-block-digest", ""), block.by):
        raise Damaged("the block's digest doesn't agree")
    revisit, length = kind == "revisit", http.get("content-length", "")
    if not revisit:
        if stated and not _agrees(stated, sent.by) and not _agrees(stated, whole.by):
            raise Damaged("the payload's digest doesn't agree")
        if kind == "response" and not chunks and length.isdigit() and int(length) != sent.size and "content-encoding" not in http:
            raise Damaged("the payload's length doesn't agree")
    own = base64.b32encode(whole.by["sha1"].digest()).decode()
    name, _, value = (stated or "").partition(":")
    return {
        "page_id": id_of(head.get("warc-record-id")),
        "url": head.get("warc-target-uri"),
        "payload_bytes": whole.size if not revisit else int(length) if length.isdigit() else None,
        "payload_digest": own if not revisit else value if name.lower() == "sha1" else None,
        "record_type": kind,
        "refers_to": id_of(head.get("warc-refers-to")),
        "record_id": head.get("warc-record-id"),
        "payload": b"".join(kept) if keep and not revisit else None,
    }


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{folder}/part-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:12]}"
        file, path, size, count, k = None, "", 0, 0, 0

        def closed() -> pa.RecordBatch:
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for page, url, payload, refers_to, revisit in zip(*batch.columns, strict=True):
                if file is None:
                    path, size, count, k = f"{stem}-{k:05d}.warc.gz", 0, 0, k + 1
                    file = open_shared(path, "wb")
                data = member(record(page.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py()))
                file.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    file = None
        if file is not None:
            yield closed()

    return run


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record for each row; returns (path, records, bytes) of the archives.

    Of rows with equal payloads of at least `least` bytes, that with the largest id is the response
    and the others revisit it.  Rows that repeat the largest id as well are responses; a null id is
    smaller than any other, and where all ids are null all rows are responses.  Null html is empty.
    folder: where all executors can write; a new one in the shared folder otherwise.  Files of lost
    task attempts stay unread, as only paths that are returned count.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), utf8(html).alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload")})
    groups = rows.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("page").alias("top"), F.count("*").alias("n"))
    groups = spool(groups.where((F.col("n") > 1) & F.col("top").isNotNull()).select("sha1", "size", "top"), "payloads")
    # salted, so that a payload which a third of all rows have goes to several tasks
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha1", "size", "salt"], "left")
    revisit = F.col("top").isNotNull() & ~F.col("page").eqNullSafe(F.col("top"))
    rows = rows.select("page", "url", "payload", F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit"))
    return spool(rows.mapInArrow(_writer(folder), "path string, records long, bytes long"), "archives")


def _reader(with_payload: bool):
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "record_id": pa.string()} | ({"payload": pa.binary()} if with_payload else {})

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0):
                with open_shared(path.as_py(), "rb") as file:
                    rows, size = [], 0
                    for found in read_records(file, with_payload):
                        rows.append(found)
                        size += len(found["payload"] or b"")
                        if size >= 8 << 20 or len(rows) >= 2000:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)

    return run


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives in the first column of paths, read one after the other.

    Returns page_id (null for identifiers that write_archives didn't give), url, payload_bytes and payload_digest
    (both of the full payload, also for revisits that state them), record_type, refers_to, record_id and payload
    (null for revisits), a row for each record of any type.  Raises where framing or digests don't agree; digests
    that a record doesn't have, or of unknown algorithms, aren't checked.  No paths give no rows.
    """
    n = paths.count()
    parts = paths.select(paths.columns[0]).repartition(max(1, min(n, 4 * paths.sparkSession.sparkContext.defaultParallelism)))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string" + ", payload binary" * with_payload
    return parts.mapInArrow(_reader(with_payload), schema)
