"""WARC files: a writer with revisit records and a splittable reader.

Writing.  Pages with equal payloads (by SHA-1, at least ``min_bytes`` long) are
one ``response``, that of the largest id, and ``revisit`` records that refer to
it.  Each record is a gzip member of its own.  A task writes files of its own
under fresh names, moves them into place when they are complete and reports
them; only reported files are read, so a task that is run again or lost leaves
no half-written or doubled archive.

Reading.  Files are cut into byte ranges and each range is a task's.  The task
looks for gzip magic, takes a candidate for a member only if its first bytes
inflate to a WARC header, and owns every record whose member starts inside the
range; the last one may end beyond it.  From the first member on the next starts
where the last ended.

Defined cases: a null page is an empty payload, a null url leaves out the target,
a null id is written as ``null`` and read back as null.  Repeated rows are records of
their own: with the largest id twice both are responses, other repeats revisits.
Texts of any length are written whole; a record must fit in a task's memory.  Empty
tables give no file and an empty result; other columns are ignored.  A payload that
itself holds a gzip member of a WARC record, in an archive whose members are stored
and not compressed, is taken for a record if a range begins inside it; UTF-8 text
can't hold the magic, so pages never do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize, table
from .sieve import split

MAGIC = b"\x1f\x8b\x08"
_URN = "urn:quillspark:page:"
_BLOCK = 1 << 20
RECORDS = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id) -> str:
    return f"<{_URN}{'null' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, out: str, min_bytes: int = 0, level: int = 4, file_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write page_id, url, html as WARC under the folder ``out``; the files as (path, bytes, records)."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("k", F.conv(F.hex(F.substring("sha1", 1, 8)), 16, -10).cast("long"))
    same = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1", "k").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = materialize(same.select("sha1", "k", "first_id", F.lit(True).alias("shared")), "payloads")
    # only pages whose payload may occur twice are moved to their group
    maybe, single = split(rows, "k", same.select("k"))
    maybe = maybe.drop("k").join(same.drop("k").hint("merge"), "sha1", "left")
    single = single.drop("k").withColumns({"first_id": F.lit(None).cast(same.schema["first_id"].dataType), "shared": F.lit(None).cast("boolean")})
    revisit = F.coalesce(F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    rows = single.unionByName(maybe).select("page_id", "url", "payload", "sha1", "first_id", revisit.alias("revisit"))

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(out)
        part = TaskContext.get().partitionId()
        handle = path = None
        size = count = 0
        done = []

        def close():
            handle.close()
            final = f"{root}/part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
            fs.move(path, final)
            done.append((out + final[len(root) :], size, count))

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, sha1, first, again = (batch.column(j)[i].as_py() for j in range(6))
                if handle is None:
                    fs.create_dir(root, recursive=True)
                    path, size, count = f"{root}/_open-{uuid.uuid4().hex}", 0, 0
                    handle = fs.open_output_stream(path)
                packer = zlib.compressobj(level, wbits=31)
                data = packer.compress(record(page, url, payload, base64.b32encode(sha1).decode(), first, again, date)) + packer.flush()
                handle.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    close()
                    handle = None
        if handle is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "bytes", "records"])

    return materialize(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-files")


class _Window:
    """Bytes of a file from any offset, read in blocks."""

    def __init__(self, handle):
        self.handle, self.at, self.data = handle, 0, b""

    def get(self, offset: int, n: int) -> bytes:
        if not (self.at <= offset and offset + n <= self.at + len(self.data)):
            self.handle.seek(offset)
            self.at, self.data = offset, self.handle.read(max(n, _BLOCK))
        return self.data[offset - self.at : offset - self.at + n]


def _starts_record(window: _Window, offset: int, size: int) -> bool:
    """Whether the bytes at ``offset`` inflate to a WARC header."""
    n = 512
    while True:
        raw = window.get(offset, min(n, size - offset))
        try:
            head = zlib.decompressobj(wbits=31).decompress(raw, 8)
        except zlib.error:
            return False
        if len(head) >= 7:
            return re.match(rb"WARC/\d", head) is not None
        if n >= size - offset or n > 1 << 16:
            return False
        n *= 4


def _next_member(window: _Window, offset: int, end: int, size: int) -> int | None:
    """The first valid member that starts in [offset, end)."""
    while offset < end:
        piece = window.get(offset, min(_BLOCK // 2, size - offset))
        at = piece.find(MAGIC)
        if at < 0:
            offset += max(1, len(piece) - len(MAGIC) + 1)
        elif offset + at >= end:
            return None
        elif _starts_record(window, offset + at, size):
            return offset + at
        else:
            offset += at + 1
        if size - offset < len(MAGIC):
            return None
    return None


def _inflate(window: _Window, offset: int, size: int) -> tuple[bytes, int]:
    """(content, end) of the member at ``offset``."""
    d, out = zlib.decompressobj(wbits=31), []
    while offset < size:
        raw = window.get(offset, min(_BLOCK // 4, size - offset))
        out.append(d.decompress(raw))
        offset += len(raw) - len(d.unused_data)
        if d.eof:
            return b"".join(out), offset
    raise ValueError("the archive ends inside a member")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of the records in a member."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        headers = {}
        for line in data[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            headers[key.strip().lower()] = value.strip()
        start = head + 4
        end = start + int(headers["content-length"])
        yield headers, data[start:end]
        at = end + 4


def read_range(handle, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records whose member starts in [start, end)."""
    window = _Window(handle)
    at = _next_member(window, start, end, size)
    while at is not None and at < end:
        data, after = _inflate(window, at, size)
        for headers, block in parse_records(data):
            yield at, headers, block
        if after >= end:
            return
        at = after if window.get(after, min(3, size - after)) == MAGIC and _starts_record(window, after, size) else _next_member(window, after, end, size)


def _payload(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """(payload in the record, length of the full payload)."""
    if "application/http" not in headers.get("content-type", ""):
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    if headers.get("warc-type") != "revisit":
        return body, len(body)
    told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return b"", int(told[1]) if told else 0


def read_warc(files: DataFrame, split_bytes: int = 64 << 20, payloads: bool = True) -> DataFrame:
    """Records of the files (path, bytes): see ``RECORDS``.

    ``payload_digest`` is computed from the payload where the record holds it,
    and is the recorded one in a revisit.  Without ``payloads`` that column is null.
    """
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(batch.column(j).to_pylist() for j in range(3))):
                fs, place = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(place) as handle:
                    for at, headers, block in read_range(handle, start, start + split_bytes, size):
                        body, length = _payload(headers, block)
                        kind = headers.get("warc-type")
                        digest = base32_sha1(body) if kind != "revisit" else headers.get("warc-payload-digest", "").rpartition(":")[2]
                        rows.append((path, at, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), digest, length, body if payloads else None))
                        held += len(body)
                        if held > 8 << 20:
                            yield _records(rows)
                            rows, held = [], 0
                if rows:
                    yield _records(rows)

    n = files.select(F.sum(F.floor(F.col("bytes") / split_bytes) + 1)).first()[0] or 1
    return ranges.repartition(int(n)).mapInArrow(run, RECORDS)  # a stated number: adaptive execution sees small rows and would make one task of all ranges


def _records(rows):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def page_number(column: str):
    """The id in a record name; null where it was null."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<{_URN}(.*)>$', 1) AS bigint)")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), fresh_path(spark, "warc"))
    return read_warc(files, split_bytes=8 << 20, payloads=False).select(
        page_number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_number("refers_to").alias("refers_to"),
    )


#: Base32 of the SHA-1, five bits at a time.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS keep, sha1(html) AS h FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
         (('0x' || substr(h, 1 + (i // 8) * 10, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM d
"""
