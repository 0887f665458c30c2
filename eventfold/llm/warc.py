"""WARC archives of web pages: writing, and a sequential reader.

Every record is one gzip member of its own, so an archive can be entered at any
member and a broken one costs one record. The reader goes through a file once:
it inflates the current member piece by piece, takes the header up to the blank
line, frames the block by ``Content-Length`` and hashes block and payload as
they pass. A record whose framing, block digest or payload digest is wrong
raises; memory is one piece of the file, one piece of inflated data and, if the
payload is asked for, the payload.

Pages with equal payloads (SHA-1 and length, of ``min_bytes`` at least) are
stored once: the one with the largest page_id is the ``response``, the others
are ``revisit`` records that hold the HTTP header only and name it
(``WARC-Refers-To``). The HTTP header's own ``Content-Length`` and the payload
digest are those of the full payload in both.

Which row is the response is found on narrow rows (digest, page_id, url) by
partial aggregates, so a payload that a third of all pages share is reduced
before it is shuffled; only groups of two and more are joined back.

Defined cases: a null html is an empty payload. A null page_id counts as smaller than
any other; its revisits refer to null if the response has none. Among rows of one page_id and payload the largest
url (null smallest) is the response; of rows equal in all three, one is. A null url is written as
``urn:page:<page_id>``, blanks and controls in a url are percent-encoded. An
empty table writes no file. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_filesystem, materialize, shared_path

PIECE = 1 << 16
LEVEL = 3
#: A task starts a new archive when the one it writes has so many bytes.
ARCHIVE_BYTES = 1 << 30
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: No header is longer; a member that goes on without a blank line is not a record.
MAX_HEADER = 1 << 20


def digest32(sha1: bytes) -> str:
    """Bare upper-case base32."""
    return base64.b32encode(sha1).decode()


def _uri(url: str) -> str:
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


class Page(NamedTuple):
    page_id: int | None
    url: str | None
    sha1: bytes
    n_bytes: int
    payload: bytes | None       #: None: a revisit
    place: str = ""             #: what tells records of equal page_id, url and payload apart; '' for one that others refer to
    refers_to: int | None = None
    refers_url: str | None = None


def record_id(page_id: int | None, url: str | None, sha1: bytes, place: str = "") -> str:
    h = hashlib.sha256(repr((page_id, url, sha1, place)).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def _lines(first: bytes, fields: list[tuple[str, str]]) -> bytes:
    return first + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def record(page: Page, date: str = DATE) -> bytes:
    """The bytes of one record, not compressed."""
    http = _lines(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(page.n_bytes))])
    block = hashlib.sha1(http)
    if page.payload is not None:
        block.update(page.payload)
    name = "none" if page.page_id is None else str(page.page_id)
    target = f"urn:page:{name}" if page.url is None else _uri(page.url)
    fields = [("WARC-Type", "response" if page.payload is not None else "revisit"),
              ("WARC-Record-ID", record_id(page.page_id, page.url, page.sha1, page.place)), ("WARC-Date", date),
              ("WARC-Target-URI", target), ("WARC-Payload-Digest", "sha1:" + digest32(page.sha1)),
              ("WARC-Block-Digest", "sha1:" + digest32(block.digest())), ("Page-ID", name)]
    if page.payload is None:
        fields += [("WARC-Profile", PROFILE),
                   ("WARC-Refers-To", record_id(page.refers_to, page.refers_url, page.sha1)),
                   ("Refers-To-Page-ID", "none" if page.refers_to is None else str(page.refers_to))]
    body = page.payload or b""
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(body)))]
    return _lines(VERSION, fields) + http + body + b"\r\n\r\n"


class ArchiveWriter:
    """Appends records to a binary stream, one gzip member each."""

    def __init__(self, out, level: int = LEVEL, date: str = DATE) -> None:
        self.out, self.level, self.date, self.n_records, self.n_bytes = out, level, date, 0, 0

    def add(self, page: Page) -> None:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = z.compress(record(page, self.date)) + z.flush()
        self.out.write(data)
        self.n_records += 1
        self.n_bytes += len(data)


class Record(NamedTuple):
    headers: dict[str, str]     #: names in lower case
    http: dict[str, str]
    payload_bytes: int          #: bytes of the payload in the record
    sha1: bytes                 #: of these bytes
    payload: bytes | None


class _Member:
    """One gzip member, inflated on demand. ``rest`` is what follows it in the file."""

    def __init__(self, source: BinaryIO, rest: bytes) -> None:
        self.source, self.z, self.feed, self.ended = source, zlib.decompressobj(31), rest, False

    def more(self) -> bytes:
        """At most PIECE inflated bytes; empty at the member's end."""
        while not self.ended:
            if not self.feed:
                self.feed = self.source.read(PIECE)
                if not self.feed:
                    raise ValueError("the file ends inside a record")
            out = self.z.decompress(self.feed, PIECE)
            self.feed = self.z.unconsumed_tail
            if self.z.eof:
                self.ended, self.feed = True, self.z.unused_data
            if out:
                return out
        return b""


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _check(fields: dict[str, str], name: str, sha1: bytes) -> None:
    given = fields.get(name)
    if given is not None and given != "sha1:" + digest32(sha1):
        raise ValueError(f"{fields.get('warc-record-id')}: {name} does not match")


def read_records(source: BinaryIO, payloads: bool = False) -> Iterator[Record]:
    """The records of an archive in order, each checked; payload bytes only if asked for."""
    rest = source.read(PIECE)
    while rest:
        member = _Member(source, rest)
        data = bytearray()

        def head(limit: int = MAX_HEADER) -> bytes:
            while True:
                at = data.find(b"\r\n\r\n")
                if at >= 0:
                    out = bytes(data[:at])
                    del data[:at + 4]
                    return out
                piece = member.more()
                if not piece or len(data) > limit:
                    raise ValueError("a header without end")
                data.extend(piece)

        version, fields = _fields(head())
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        left = int(fields["content-length"])
        http: dict[str, str] = {}
        block, payload, kept, size = hashlib.sha1(), hashlib.sha1(), [], 0
        in_head = fields.get("content-type", "").startswith("application/http")
        start = bytearray()
        while left:
            if not data:
                piece = member.more()
                if not piece:
                    raise ValueError("a block shorter than its Content-Length")
                data.extend(piece)
            part = bytes(data[:left])
            del data[:len(part)]
            left -= len(part)
            block.update(part)
            if in_head:
                start.extend(part)
                at = start.find(b"\r\n\r\n")
                if at < 0:
                    if not left or len(start) > MAX_HEADER:
                        raise ValueError("an HTTP header without end")
                    continue
                http = _fields(bytes(start[:at]))[1]
                part, in_head = bytes(start[at + 4:]), False
            payload.update(part)
            size += len(part)
            if payloads:
                kept.append(part)
        while True:
            piece = member.more()
            if not piece:
                break
            data.extend(piece)
            if len(data) > 4:
                break
        if bytes(data) != b"\r\n\r\n":
            raise ValueError("a block longer than its Content-Length")
        _check(fields, "warc-block-digest", block.digest())
        if fields.get("warc-type") != "revisit":
            _check(fields, "warc-payload-digest", payload.digest())
            if "content-length" in http and int(http["content-length"]) != size:
                raise ValueError("a payload of another length than its HTTP header says")
        yield Record(fields, http, size, payload.digest(), b"".join(kept) if payloads else None)
        rest = member.feed or source.read(PIECE)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_bytes: int = 0) -> DataFrame:
    """Rows (page_id, url, sha1, n_bytes, html, referred, refers_to, refers_url), one per page; html is
    null for a revisit, and ``referred`` marks the response of a group."""
    rows = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                         F.coalesce(F.col(html_col), F.lit("")).alias("html"))
            .select("page_id", "url", "html", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("sha1"),
                    F.octet_length("html").cast("long").alias("n_bytes")))
    same = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    groups = materialize(same.groupBy("sha1", "n_bytes").agg(F.max(F.struct("page_id", "url", "n")).alias("top"), F.sum("n").alias("copies"))
                         .filter("copies > 1").select("sha1", "n_bytes", "top"), "payload-groups")
    first = F.col("top").isNotNull() & F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))
    joined = rows.join(groups, ["sha1", "n_bytes"], "left")
    lone = F.col("top").isNull() | first
    refer = [F.when(~lone, F.col("top.page_id")).alias("refers_to"), F.when(~lone, F.col("top.url")).alias("refers_url")]
    cols = ["page_id", "url", "sha1", "n_bytes"]
    out = (joined.filter(F.col("top").isNull() | (F.col("top.n") == 1) | ~first)
           .select(*cols, F.when(lone, F.col("html")).alias("html"), first.alias("referred"), *refer))
    repeated = groups.filter("top.n > 1")
    if repeated.isEmpty():
        return out
    # rows equal in all columns: one html per group, taken by a partial aggregate, and as many records as there were rows
    one = (rows.join(repeated, ["sha1", "n_bytes"]).filter(first)
           .groupBy("sha1", "n_bytes").agg(F.first("html").alias("html"), F.first("top").alias("top")))
    thousands = (one.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top.n") - 1, F.lit(1000).cast("long"))))
                 .withColumn("html", F.when(F.col("from") == 0, F.col("html"))).repartition("sha1", "from"))
    each = thousands.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + 999, F.col("top.n") - 1))))
    again = F.col("copy") > 0
    return out.unionByName(each.select(
        F.col("top.page_id").alias("page_id"), F.col("top.url").alias("url"), "sha1", "n_bytes",
        F.when(~again, F.col("html")).alias("html"), (~again).alias("referred"), F.when(again, F.col("top.page_id")).alias("refers_to"),
        F.when(again, F.col("top.url")).alias("refers_url")))


def _writer(folder: str, archive_bytes: int):
    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, fs, at, n = TaskContext.get(), None, "", 0
        out = writer = None

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"name": [name], "n_records": pa.array([writer.n_records], pa.int64()),
                                               "n_bytes": pa.array([writer.n_bytes], pa.int64())})

        for part in parts:
            for i in range(len(part)):
                page_id, url, sha1, n_bytes, html, referred, refers, refers_url = (part.column(j)[i] for j in range(8))
                if writer is None:
                    if fs is None:
                        fs, at = local_filesystem(folder)
                        fs.create_dir(at, recursive=True)
                    # the attempt is in the name: only names in the manifest are read
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz"
                    out, n = fs.open_output_stream(f"{at}/{name}", compression=None), n + 1
                    writer = ArchiveWriter(out)
                payload = html.as_buffer().to_pybytes() if html.is_valid else None
                writer.add(Page(page_id.as_py(), url.as_py(), sha1.as_py(), n_bytes.as_py(), payload,
                                "" if referred.as_py() else f"{task.partitionId()}-{n}-{writer.n_records}", refers.as_py(), refers_url.as_py()))
                if writer.n_bytes >= archive_bytes:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()
    return write


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Writes the archives; returns the manifest (name, n_records, n_bytes), a table in the shared folder."""
    rows = plan_records(pages, **columns)
    return materialize(rows.mapInArrow(_writer(folder, archive_bytes), "name string, n_records bigint, n_bytes bigint"), "warc-manifest")


_READ = ("record_type string, record_id string, target_uri string, page_id bigint, payload_bytes bigint, payload_digest string, "
         "refers_to bigint, refers_to_record string")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row per response or revisit record, read from the files, a task to a
    file; with ``payloads`` also the payload (null for a revisit)."""
    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = local_filesystem(folder)
        number = lambda v: None if v in (None, "none") else int(v)
        for part in parts:
            for name in part.column(0).to_pylist():
                with fs.open_input_stream(f"{at}/{name}", compression=None) as source:
                    rows, held = [], 0
                    for r in read_records(source, payloads):
                        h = r.headers
                        if h.get("warc-type") not in ("response", "revisit"):
                            continue
                        rows.append((h["warc-type"], h["warc-record-id"], h["warc-target-uri"], number(h.get("page-id")),
                                     int(r.http["content-length"]), h["warc-payload-digest"].partition(":")[2],
                                     number(h.get("refers-to-page-id")), h.get("warc-refers-to"),
                                     *([r.payload if h["warc-type"] == "response" else None] if payloads else [])))
                        held += len(r.payload or b"")
                        if len(rows) == 10_000 or held >= 1 << 23:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in _READ.split(", ")]
    if payloads:
        kinds, names = kinds + [pa.binary()], names + ["payload"]

    def _batch(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = max(1, manifest.count())
    return (manifest.select("name").repartitionByRange(files, "name")
            .mapInArrow(read, _READ + (", payload binary" if payloads else "")))


def op11(pages: DataFrame) -> DataFrame:
    folder = shared_path(pages.sparkSession, "warc")
    return (read_archives(write_archives(pages, folder), folder)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
