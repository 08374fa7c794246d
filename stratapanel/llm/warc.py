"""WARC records in ZIP packages, read back by byte ranges.

A package is a ZIP file with two stored (not deflated) members: ``archive/data.warc.gz``, one gzip member
for each record, and ``indexes/index.cdx``, a line with id, offset and length for each record. The reader
parses the end record, the ZIP64 records and the central directory, locates both members and range-reads
records out of the archive without unpacking it.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh_path, materialise

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
MIN_REVISIT_BYTES = 100
#: a package is closed once it has so many bytes
PACKAGE_BYTES = 64 << 20
#: neighbouring records are read together up to so many bytes
READ_BYTES = 1 << 20
#: so many of the most repeated payloads are sent to all executors
HOT_PAYLOADS, HOT_COPIES = 1000, 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    kind: str
    page_id: int | None
    target: str
    refers_to: int | None
    digest: str
    payload_bytes: int
    payload: bytes | None  # null for a revisit


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn[10:-1] else None


def build_record(r: Record) -> bytes:
    """A WARC/1.1 record whose block is an HTTP response, without its body for a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % r.payload_bytes + (r.payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {r.kind}", f"WARC-Record-ID: {_urn(r.page_id)}", f"WARC-Target-URI: {quote(r.target, safe=':/?#[]@!$&()*+,;=%~')}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{r.digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if r.kind == "revisit":
        head += [f"WARC-Refers-To: {_urn(r.refers_to)}", f"WARC-Profile: {_PROFILE}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["warc-type"]
    return Record(kind, _page(fields["warc-record-id"]), fields["warc-target-uri"], _page(fields.get("warc-refers-to")), fields["warc-payload-digest"].removeprefix("sha256:"), size, None if kind == "revisit" else body)


class PackageWriter:
    """Streams records into a package; only the index is held in memory."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, record: Record) -> None:
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        raw = squeeze.compress(build_record(record)) + squeeze.flush()
        self.data.write(raw)
        self.lines.append(f"{'' if record.page_id is None else record.page_id} {self.size} {len(raw)}\n")
        self.size += len(raw)

    def close(self) -> int:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()
        return len(self.lines)


@dataclass
class Member:
    method: int
    size: int
    header: int


class PackageReader:
    """Members of a ZIP file that is only seen through ``read(offset, length)``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.members = read, {}
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no ZIP file: the end record is missing")
        entries, length, start = struct.unpack_from("<10xHII", tail, end)
        locator = tail_at + end - 20
        if locator >= 0 and (mark := read(locator, 20))[:4] == b"PK\6\7":
            record = read(struct.unpack_from("<8xQ", mark)[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("broken ZIP64 end record")
            entries, length, start = struct.unpack_from("<32xQQQ", record)
        self._directory(read(start, length), entries)

    def _directory(self, raw: bytes, entries: int) -> None:
        at = 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, packed, size, n_name, n_extra, n_comment, header = struct.unpack_from("<10xH8xIIHHH8xI", raw, at)
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # in this order, only those that don't fit in 32 bits
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            self.members[name] = Member(method, size, header)
            at += 46 + n_name + n_extra + n_comment

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; only stored members can be range-read")
        head = self.read(m.header, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("broken local header")
        return m.header + 30 + sum(struct.unpack_from("<26xHH", head)), m.size

    def records(self) -> Iterator[Record]:
        """All records in the index's order, neighbours read together."""
        at, size = self.locate(INDEX)
        rows = [tuple(map(int, line.split(b" ")[1:])) for line in self.read(at, size).splitlines()]
        base, _ = self.locate(ARCHIVE)
        k = 0
        while k < len(rows):
            first, stop, to = rows[k][0], k, rows[k][0]
            while stop < len(rows) and rows[stop][0] == to and (stop == k or to + rows[stop][1] - first <= READ_BYTES):
                to += rows[stop][1]
                stop += 1
            raw = self.read(base + first, to - first)
            for offset, length in rows[k:stop]:
                yield parse_record(zlib.decompress(raw[offset - first : offset - first + length], 31))
            k = stop


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest``, ``kind`` and ``refers_to`` of each page's record.

    Of equal payloads of at least 100 bytes the smallest page_id is the response and the others revisit
    it; rows that repeat that page_id are responses too. Smaller payloads are all responses. Null html
    is an empty payload; a null page_id revisits where another page has its payload. Page ids are whole numbers, also as text; any other text is
    an error. The payloads with the most copies (a bounded number) are joined by broadcast; of the others a very
    frequent one is a skewed key of a left join with one row on its right, which Spark splits.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.length("payload") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = materialise(firsts, "repeated-payloads")
    hot = firsts.where(F.col("n") >= HOT_COPIES).orderBy(F.desc("n"), "digest").limit(HOT_PAYLOADS)
    hot = materialise(hot, "hot-payloads").select("digest", F.col("first").alias("hot_first"))
    cold = firsts.join(F.broadcast(hot), "digest", "left_anti").select(F.col("digest").alias("key"), "first")
    # rows that can't match a cold payload are dealt evenly
    apart = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    marked = rows.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(F.col("hot_first").isNull() & (F.length("payload") >= MIN_REVISIT_BYTES), F.col("digest")).otherwise(apart))
    first = F.coalesce("hot_first", "first")
    revisits = first.isNotNull() & ~first.eqNullSafe(F.col("page_id"))
    return marked.join(cold, "key", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisits, "revisit").otherwise("response").alias("kind"), F.when(revisits, first).alias("refers_to")
    )


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``plan_records`` as packages below ``folder``: ``path``, ``size`` and ``n_records`` of each.

    Packages have names of their own for every attempt of a task, and only those of the attempt that
    succeeded are returned, so a retry or a lost executor leaves no half package behind in the result.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        writer = out = path = None

        def close() -> pa.RecordBatch:
            n = writer.close()
            out.close()
            size = system.get_file_info(f"{root}/{path}").size
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "size": [size], "n_records": [n]})

        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    path = f"{uuid.uuid4().hex}.wacz"
                    out = system.open_output_stream(f"{root}/{path}")
                    writer = PackageWriter(out)
                writer.add(Record(kind, page_id, url or f"urn:page:{page_id}", refers_to, digest, len(payload), None if kind == "revisit" else payload))
                if writer.size >= PACKAGE_BYTES:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return materialise(records.mapInArrow(write, "path string, size bigint, n_records bigint"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """All records of the packages: page_id, kind, target, refers_to, digest (from the header), payload_bytes, payload."""
    shape = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("target", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def batch_of(rows: list[Record]) -> pa.RecordBatch:
        columns = zip(*((r.page_id, r.kind, r.target, r.refers_to, r.digest, r.payload_bytes, r.payload) for r in rows), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _filesystem(uri)
                with system.open_input_file(path) as source:
                    rows, held = [], 0
                    for record in PackageReader(lambda at, n, source=source: source.read_at(n, at), size).records():
                        rows.append(record)
                        held += len(record.payload or b"")
                        if held >= 4 << 20 or len(rows) >= 1000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    spread = packages.select("path", "size").repartition(packages.sparkSession.sparkContext.defaultParallelism * 2, "path")
    return spread.mapInArrow(read, "page_id bigint, kind string, target string, refers_to bigint, digest string, payload_bytes bigint, payload binary")


def packages_folder(pages: DataFrame) -> str:
    return fresh_path(pages.sparkSession, "warc")
