"""WARC archives: a writer of pages and a sequential reader.

Every record is a gzip member of its own. The writer gives each task its own files, named anew
by each attempt, and returns a manifest of the files; a file counts only if the manifest names it,
so that lost executors, repeated and speculative tasks leave nothing wrong. The reader goes
through a file from front to back: it inflates a member block by block, takes the header
up to its empty line, then as many bytes as ``Content-Length`` says, hashes the block and the payload while
they pass and compares both with the digests of the header. Its memory is a block and a header, unless
payloads are asked for.

A payload of at least ``least`` bytes that several pages have is written once, as the response
of the largest page_id; the other pages become revisit records that refer to it. Repeated payloads are found
by SHA-256, then counted, so that the digests alone are shuffled; payloads that are hot or few are
joined by a broadcast of a counted size.

Results: a null html is an empty payload, a null url ``about:blank``. Rows without a page_id are never
referred to: they revisit the page that has their payload, else they are responses. Rows that repeat the largest
page_id with its payload are responses each and share a record id. Extra columns are ignored. A damaged
member gives one row with ``error`` and reading goes on at the next member that holds a
record; a wrong digest gives the row with ``error``. Without pages there are no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_hot

LEAST = 1000
ARCHIVE_BYTES = 256 << 20
LEVEL = 5
FEW = 200_000
BLOCK, READ = 1 << 16, 1 << 13
BUFFER = 1 << 20
HEADER_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"

MANIFEST = "path string, bytes long, records long"
RECORDS = (
    "path string, position long, record_id string, record_type string, uri string, page_id long, refers_to_record string, "
    "payload_bytes long, payload_digest string, verified boolean, error string"
)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _record_id(page_id, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest.hex()}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _framed(fields, block: bytes) -> bytes:
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """The bytes of a page's response, or of its revisit of the page ``refers_to``."""
    sha = hashlib.sha1(payload, usedforsecurity=False).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    return _framed(
        [
            ("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", _record_id(page_id, sha)),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%~") if url else "about:blank"),
            ("WARC-Profile", None if refers_to is None else SAME_PAYLOAD),
            ("WARC-Refers-To", None if refers_to is None else _record_id(refers_to, sha)),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha).decode()),
            ("WARC-Block-Digest", _sha1(block)),
            ("X-Page-Id", page_id),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def _member(data: bytes, level: int) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def with_heads(spark: SparkSession, pages: DataFrame, work: Workspace, least: int = LEAST, few: int = FEW) -> DataFrame:
    """page_id, url, payload and refers_to: the page that has the payload as its response, null for responses."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    key = F.sha2("payload", 256)
    keyed = rows.where(F.octet_length("payload") >= least).select("page_id", key.alias("key"))
    heads = keyed.groupBy("key").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1 and head is not null")
    heads = work.table(heads, "heads")
    # payloads that are too short to be compared get keys that spread them
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, key).otherwise(F.concat(F.lit("-"), F.hash("page_id", "url").cast("string"))))
    out = ["page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to")]
    if heads.count() <= few:
        return rows.join(F.broadcast(heads.drop("n")), "key", "left").select(*out)
    hot = heads.orderBy(F.desc("n"), "key").limit(few)  # the rest occur seldom: the keys of a partition differ
    hot = work.table(hot, "hot")
    met = rows.join(F.broadcast(hot.drop("n")), "key").select(*out)
    rest = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(heads.drop("n"), "key", "left").select(*out)
    return met.unionByName(rest)


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes page_id, url, payload and refers_to to archives in ``folder``: path, bytes and records of each.

    The rows that come out name the files that count: write them as a table before any file is read.
    """

    def run(batches):
        system, root = _system(folder)
        system.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        out, name, done, size, records = None, None, [], 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", size, records))
                out = None

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{task:05d}-{len(done):04d}-{attempt}.warc.gz"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    head = _member(_framed(info, b"software: skein\r\nformat: WARC file version 1.1\r\n"), level)
                    out.write(head)
                    size, records = len(head), 0
                data = _member(page_record(page_id, url, payload, refers_to), level)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "records"), x, strict=True)) for x in done])

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, MANIFEST)


class BadRecord(ValueError):
    """A member that is cut off, isn't gzip, or holds no record."""


class _Member:
    """The inflated bytes of one gzip member, taken in order."""

    def __init__(self, file, position: int):
        self.file, self.left, self.ready = file, zlib.decompressobj(31), bytearray()
        self.read_to = position
        file.seek(position)

    def fill(self) -> bool:
        """One more block; False at the end of the member."""
        if self.left.eof:
            return False
        data = self.left.unconsumed_tail
        if not data:
            data = self.file.read(READ)
            self.read_to += len(data)
        more = self.left.decompress(data, BLOCK)
        if not (data or more or self.left.eof):
            raise BadRecord("the member is cut off")
        self.ready += more
        return True

    def until(self, mark: bytes, most: int) -> bytes:
        seen = 0
        while (at := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if seen > most or not self.fill():
                raise BadRecord("a header doesn't end")
        head = bytes(self.ready[: at + len(mark)])
        del self.ready[: at + len(mark)]
        return head

    def take(self, n: int):
        """The next ``n`` bytes in blocks."""
        while n:
            if not self.ready and not self.fill():
                raise BadRecord("the record is shorter than its Content-Length")
            part = bytes(self.ready[:n])
            del self.ready[:n]
            n -= len(part)
            if part:
                yield part

    def end(self) -> int:
        """The position after the member, which must hold nothing but the end of its record."""
        while self.fill():
            if len(self.ready) > 4:
                break
        if bytes(self.ready) != b"\r\n\r\n":
            raise BadRecord("the record is longer than its Content-Length")
        return self.read_to - len(self.left.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise BadRecord("no WARC header")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _read_record(file, position: int, payloads: bool) -> tuple[dict, int]:
    member = _Member(file, position)
    fields = _fields(member.until(b"\r\n\r\n", HEADER_BYTES))
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise BadRecord("no Content-Length")
    block, payload, kept, size, http = hashlib.sha1(usedforsecurity=False), hashlib.sha1(usedforsecurity=False), [], 0, bytearray()
    inside = fields.get("content-type", "").startswith("application/http")
    for part in member.take(int(length)):
        block.update(part)
        if inside:
            http += part
            if (at := http.find(b"\r\n\r\n", max(0, len(http) - len(part) - 3))) < 0:
                if len(http) > HEADER_BYTES:
                    raise BadRecord("a header doesn't end")
                continue
            part, inside = bytes(http[at + 4 :]), False
        payload.update(part)
        size += len(part)
        if payloads:
            kept.append(part)
    end = member.end()
    kind, wrong = fields.get("warc-type"), []
    own = "sha1:" + base64.b32encode(payload.digest()).decode()
    told = fields.get("warc-payload-digest")
    if told and kind != "revisit" and told.upper() != own.upper():
        wrong.append("payload digest")
    if (x := fields.get("warc-block-digest")) and x.upper() != ("sha1:" + base64.b32encode(block.digest()).decode()).upper():
        wrong.append("block digest")
    page = fields.get("x-page-id")
    digest = payload.hexdigest()
    if kind == "revisit":  # its payload is elsewhere
        size, digest = None, base64.b32decode(told[5:].upper()).hex() if told and re.fullmatch(r"(?i)sha1:[A-Z2-7]{32}", told) else None
    row = {
        "position": position, "record_id": fields.get("warc-record-id"), "record_type": kind, "uri": fields.get("warc-target-uri"), "page_id": int(page) if page and re.fullmatch(r"-?[0-9]{1,19}", page) and -(1 << 63) <= int(page) < 1 << 63 else None,
        "refers_to_record": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "verified": not wrong, "error": ", ".join(wrong) or None,
    }
    if payloads:
        row["payload"] = None if kind == "revisit" else b"".join(kept)
    return row, end


def _next_magic(file, position: int, size: int) -> int:
    """Where the next member may begin, or the end of the file."""
    tail = b""
    file.seek(position)
    while position < size:
        data = tail + file.read(BLOCK)
        if (at := data.find(MAGIC)) >= 0:
            return position - len(tail) + at
        position += len(data) - len(tail)
        tail = data[-2:]
    return size


def records_of(file, size: int, payloads: bool = False):
    """Rows of all records of an open archive, in order."""
    position, lost = 0, False
    while position < size:
        try:
            row, position = _read_record(file, position, payloads)
            lost = False
            yield row
        except (BadRecord, zlib.error) as error:
            if not lost:
                yield {"position": position, "verified": False, "error": str(error)}
            lost = True
            position = _next_magic(file, position + 1, size)


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the files named by ``path``, each read from front to back by one task."""
    schema = RECORDS + (", payload binary" if payloads else "")
    kinds = {"position": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "verified": pa.bool_(), "payload": pa.binary()}
    names = [x.split()[0] for x in schema.split(", ")]
    target = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    rows_of_batch, bytes_of_batch = 4096, 8 << 20

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = _system(path)
                with system.open_input_file(name) as raw:
                    size, file = raw.size(), io.BufferedReader(raw, BUFFER)
                    rows, held = [], 0
                    for row in records_of(file, size, payloads):
                        rows.append({"path": path} | row)
                        held += len(row.get("payload") or b"")
                        if len(rows) >= rows_of_batch or held >= bytes_of_batch:
                            yield pa.RecordBatch.from_pylist(rows, target)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, target)

    files = max(1, archives.count())
    return archives.select("path").repartition(files).mapInArrow(run, schema)


def resolved(records: DataFrame, work: Workspace) -> DataFrame:
    """Page records with revisits filled from the responses they refer to: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    A revisit whose response isn't there, isn't verified or has another digest keeps its own digest, is not verified and has nulls.
    """
    pages = records.where(F.col("record_type").isin("response", "revisit"))
    own = pages.where("record_type = 'response'")
    revisits = pages.where("record_type = 'revisit'").select("page_id", "refers_to_record", "payload_digest", "verified")
    asked = revisits.where("refers_to_record is not null").groupBy("refers_to_record").agg(F.count(F.lit(1)).alias("n"))
    there = own.where("verified").groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.first("page_id").alias("head"), F.first("payload_bytes").alias("head_bytes"), F.first("payload_digest").alias("head_digest")
    )
    keys = work.table(asked.join(there, "refers_to_record", "left"), "referred")
    good = F.col("verified") & F.coalesce(F.col("head_digest") == F.col("payload_digest"), F.lit(False))
    met = join_hot(revisits.where("refers_to_record is not null"), keys, ["refers_to_record"], "n")
    met = met.select("page_id", F.when(good, F.col("head_bytes")).alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), F.when(good, F.col("head")).alias("refers_to"), good.alias("verified"))
    null = F.lit(None).cast("long")
    own = own.select("page_id", "payload_bytes", "payload_digest", "record_type", null.alias("refers_to"), "verified")
    lone = revisits.where("refers_to_record is null").select("page_id", null.alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), null.alias("refers_to"), F.lit(False).alias("verified"))
    return own.unionByName(met).unionByName(lone)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per page into ``folder`` and reads all archives back: one row per page."""
    work = Workspace(spark, "warc")
    manifest = work.table(write_archives(with_heads(spark, pages, work, least), folder or f"{work.root}/archives", archive_bytes), "manifest")
    return resolved(work.table(read_archives(manifest), "records"), work)
