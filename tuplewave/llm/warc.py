"""WARC records in ZIP-packaged archives.

An archive is a ZIP file of stored (not compressed) members, written as ``archive/data.warc.gz`` with one gzip member for
each record, ``indexes/index.cdxj`` with a line for each record, and ``datapackage.json``. The reader finds the end
record, follows the ZIP64 locator and record when fields overflow, reads the central directory, locates in it the stored
members with WARC records (``*.warc``, ``*.warc.gz``) and the indexes (``*.cdxj``, ``*.cdx``, also gzipped), and reads the
records by the byte ranges of the index lines; nothing is extracted, and of an index a part at a time is held. WARC members
that no index names are read record by record from their beginning.

Records of other writers need no block or payload digest; those that are there are verified. A record is told by its own
id, ids as written here by the page's. Nulls: a null payload is empty, a null url is an empty target, and a page without
id is written without one and read back as null. Equal payloads: the page with the smallest id is the response, the others
are revisits; rows that repeat that id are responses too, and without any id each row is a response. Empty tables give no
archive and empty results. Only the id, the url and the payload are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ready, scratch_path

#: Members as they are written; a reader goes by the names' ends.
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
_WARCS, _INDEXES = (".warc.gz", ".warc"), (".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")
#: Bytes of an index or of a record without index that are fetched at once.
PART = 1 << 20
#: An archive is closed when its records reach this size.
ARCHIVE_BYTES = 256 << 20
#: Archives are dealt one by one to at most this many reading tasks.
MOST_READERS = 20_000
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


class ZipWriter:
    """Stored members, written as a stream; ZIP64 records where sizes, offsets or counts need them, or always."""

    def __init__(self, out: BinaryIO, zip64: bool = False) -> None:
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open_member(self, name: str) -> None:
        self.name, self.begun, self.size, self.crc = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        # Sizes follow the data (flag 8) as 64-bit fields, since they are not known yet.
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x808, 0, 0, 0x21, 0, _MAX32, _MAX32, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)

    def close_member(self) -> None:
        self._put(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.begun, self.size, self.crc))

    def close(self) -> None:
        start = self.at
        for name, begun, size, crc in self.members:
            big = self.zip64 or size >= _MAX32 or begun >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, begun) if big else b""
            shown = (_MAX32, _MAX32) if big else (size, size)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x808, 0, 0, 0x21, crc, *shown, len(name), len(extra), 0, 0, 0, 0, _MAX32 if big else begun) + name + extra)
        size, n, end = self.at - start, len(self.members), self.at
        big = self.zip64 or start >= _MAX32 or size >= _MAX32 or n >= _MAX16
        if big:
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, *(2 * (_MAX16 if big else n,)), _MAX32 if big else size, _MAX32 if big else start, 0))


def record(page_id: object, url: str | None, payload: bytes, kind: str, refers_to: object = None) -> bytes:
    """One WARC record. A revisit holds the HTTP head alone, whose Content-Length is still that of the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    def __init__(self, out: BinaryIO, zip64: bool = False) -> None:
        self.zip, self.lines, self.at = ZipWriter(out, zip64), [], 0
        self.zip.open_member(DATA)

    def add(self, data: bytes, key: str) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = pack.compress(data) + pack.flush()
        self.lines.append(f'{key or "-"} 19700101000000 {{"offset": "{self.at}", "length": "{len(packed)}", "filename": "{DATA.rpartition("/")[2]}"}}\n')
        self.zip.write(packed)
        self.at += len(packed)

    def close(self) -> None:
        self.zip.close_member()
        for name, data in ((INDEX, "".join(self.lines).encode()), (PACKAGE, b'{"profile": "data-package", "wacz_version": "1.1.1"}')):
            self.zip.open_member(name)
            self.zip.write(data)
            self.zip.close_member()
        self.zip.close()


# ---------------------------------------------------------------- reading


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipReader:
    """Members of a ZIP file by ranges of a seekable file of known size; ``reads`` counts the bytes fetched."""

    def __init__(self, file: BinaryIO, size: int) -> None:
        self.file, self.size, self.reads = file, size, 0
        self.members = {m.name: m for m in self._directory()}

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise EOFError(f"{n} bytes at {at} wanted, {len(data)} found")
        self.reads += n
        return data

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 22 - _MAX16)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        n, size, start = struct.unpack_from("<HII", tail, end + 10)
        if n == _MAX16 or size == _MAX32 or start == _MAX32:
            sign, _, at, _ = struct.unpack("<IIQI", self.read(tail_at + end - 20, 20))
            if sign != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            sign, *_, n, size, start = struct.unpack("<IQHHIIQQQQ", self.read(at, 56))
            if sign != 0x06064B50:
                raise ValueError("no ZIP64 end record")
        data, at = self.read(start, size), 0
        for _ in range(n):
            sign, _, _, _, method, _, _, _, packed, plain, name_n, extra_n, comment_n, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
            if sign != 0x02014B50:
                raise ValueError("bad central directory entry")
            name = data[at + 46 : at + 46 + name_n].decode()
            extra = data[at + 46 + name_n : at + 46 + name_n + extra_n]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    plain = wide.pop(0) if plain == _MAX32 else plain
                    packed = wide.pop(0) if packed == _MAX32 else packed
                    header = wide.pop(0) if header == _MAX32 else header
                extra = extra[4 + length :]
            yield Member(name, method, packed, header)
            at += 46 + name_n + extra_n + comment_n

    def start(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's data."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed")
        name_n, extra_n = struct.unpack("<HH", self.read(m.header + 26, 4))
        return m.header + 30 + name_n + extra_n, m.size

    def stored(self, name: str) -> bytes:
        return self.read(*self.start(name))

    def parts(self, name: str, at: int = 0) -> Iterator[bytes]:
        """A stored member from a place on, a part at a time."""
        start, size = self.start(name)
        for a in range(at, size, PART):
            yield self.read(start + a, min(PART, size - a))

    def named(self, ends: tuple[str, ...]) -> list[str]:
        return [n for n in self.members if n.lower().endswith(ends)]


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode(errors="replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    for line in lines:
        if line[:1] in (" ", "\t") and fields:  # a folded line goes on with the field before
            fields[last] += " " + line.strip()
            continue
        last, _, value = line.partition(":")
        last = last.strip().lower()
        fields[last] = value.strip()
    size = int(fields.get("content-length", len(rest)))
    if len(rest) < size:
        raise ValueError("the record is cut")
    block = rest[:size]
    said = fields.get("warc-block-digest", "")
    if said.lower().startswith("sha1:") and digest(block) != said[5:].upper():
        raise ValueError("block digest differs")
    return fields, block


def _inflated(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of the gzip members in ``parts``, as they come."""
    engine = None
    for data in parts:
        while data:
            engine = engine or zlib.decompressobj(31)
            yield engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine = None
    if engine:
        raise ValueError("a gzip member is cut")


def index_lines(archive: ZipReader) -> Iterator[tuple[str, int, int]]:
    """(data member, offset, length) of each line of the archive's indexes that has them: CDXJ, or CDX as its legend says.

    Lines of a file name with more than one member go to the one whose name ends so; without a file name, to the only one.
    """
    members = archive.named(_WARCS)
    for name in archive.named(_INDEXES):
        parts = archive.parts(name)
        legend: list[str] | None = None
        rest = b""
        for part in _chain(_inflated(parts) if name.lower().endswith(".gz") else parts):
            *lines, rest = (rest + part).split(b"\n")
            for raw in lines:
                line = raw.decode(errors="replace").strip("\r")
                if line.lstrip().startswith("CDX "):
                    legend = line.split()[1:]
                    continue
                if not line.strip() or line.startswith("!"):
                    continue
                brace = line.find("{")
                if legend is None and brace >= 0:
                    found = json.loads(line[brace:])
                    where, at, n = str(found.get("filename", "")), found.get("offset"), found.get("length")
                elif legend is not None:
                    found = dict(zip(legend, line.split(), strict=False))
                    where, at, n = found.get("g", ""), found.get("V"), found.get("S")
                else:
                    raise ValueError(f"{name} is neither CDXJ nor CDX with a legend")
                if at is None or n is None:
                    continue
                own = [m for m in members if not where or m == where or m.endswith("/" + where.rpartition("/")[2])]
                if len(own) != 1:
                    raise ValueError(f"{name} names {where!r}, which {len(own)} members fit")
                yield own[0], int(at), int(n)


def _chain(parts: Iterator[bytes]) -> Iterator[bytes]:
    yield from parts
    yield b"\n"


def _sequential(archive: ZipReader, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a data member without index lines, from its beginning."""
    parts = archive.parts(name)
    held = bytearray()
    for part in _chain(_inflated(parts) if name.lower().endswith(".gz") else parts):
        held += part
        while True:
            while held[:1] in (b"\r", b"\n"):
                del held[: len(held) - len(held.lstrip(b"\r\n"))]
            head = held.find(b"\r\n\r\n")
            if head < 0:
                break
            size = next((int(x.partition(b":")[2]) for x in bytes(held[:head]).split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
            if len(held) < head + 4 + size:
                break
            yield parse_record(bytes(held[: head + 4 + size]))
            del held[: head + 4 + size]
    if held.strip(b"\r\n"):
        raise ValueError(f"{name} ends inside a record")


def records(archive: ZipReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of the archive, each by one range of a stored data member where an index names it."""
    starts: dict[str, int] = {}
    for name, at, n in index_lines(archive):
        if name not in starts:
            starts[name] = archive.start(name)[0]
        data = archive.read(starts[name] + at, n)
        yield parse_record(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data)
    for name in archive.named(_WARCS):
        if name not in starts:
            yield from _sequential(archive, name)


# ---------------------------------------------------------------- Spark


def _open(path: str):
    """File system and path for any scheme that pyarrow knows: local, HDFS, S3, GCS, ABFS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def typed_pages(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """``id``, ``url``, ``payload`` and ``first``: the smallest id with an equal payload, if that is another id."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    df = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    # Content is told apart by both digests and the length, so equal keys mean equal payloads.
    key = F.struct(F.sha2("payload", 256).alias("a"), F.octet_length("payload").alias("n"))
    slim = df.where(F.col("id").isNotNull() & (F.octet_length("payload") >= least_bytes)).select("id", key.alias("key"))
    # Written, so that both sides of the join are plain exchanges and the commonest payload's pages can be split.
    groups = materialize(slim.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last").select("key", "first"), "warc-groups")
    later = slim.join(groups, "key").where("id != first").select(F.col("id").alias("later_id"), "first", F.col("key.a").alias("a")).distinct()
    return df.join(later, (F.col("id") == F.col("later_id")) & (F.sha2("payload", 256) == F.col("a")), "left").select("id", "url", "payload", "first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = True) -> DataFrame:
    """Write the archives and return the written manifest (path, bytes, records): only files of finished tasks.

    Each task attempt writes names of its own, so an attempt that is lost leaves files that no manifest lists.
    """
    ready(pages)
    typed = typed_pages(pages, id_col, url_col, payload_col, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        open_file, path = None, ""
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal open_file
            if open_file:
                stream, writer = open_file
                writer.close()
                stream.close()
                done.append((path, writer.zip.at, len(writer.lines)))
                open_file = None

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, first = (c[row].as_py() for c in batch.columns)
                if open_file is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    path = f"{folder}/{name}"
                    stream = system.open_output_stream(f"{root}/{name}")
                    open_file = stream, ArchiveWriter(stream, zip64)
                kind = "response" if first is None else "revisit"
                open_file[1].add(record(page, url, payload, kind, first), quote(url or "", safe=":/"))
                if open_file[1].at >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return materialize(typed.mapInArrow(run, "path string, bytes bigint, records bigint"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row for each record of the listed archives (column ``path``): id and refers_to (strings), url, digest, size, type,
    payload. Records of types that hold no page (``warcinfo``, ``request``, ``metadata``) come with their own type."""
    ready(manifest)
    names = ["record", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * with_payload


    def own(x: str | None) -> str | None:
        """The page's id of a record written here, any other id as it stands."""
        return x if not x or not x.startswith("<urn:page:") else x[10:].removesuffix(">") or None

    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind = fields.get("warc-type", "")
        http = fields.get("content-type", "").lower().startswith("application/http")
        head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        size = next((int(h.partition(b":")[2]) for h in head.split(b"\r\n") if h.lower().startswith(b"content-length:")), len(body))
        said = fields.get("warc-payload-digest", "")
        said = said[5:].upper() if said.lower().startswith("sha1:") else None
        if kind != "revisit":
            # Of a transfer coding the digest covers the decoded payload, of which the block says nothing.
            plain = not any(h.lower().startswith(b"transfer-encoding:") for h in head.split(b"\r\n"))
            if plain and (len(body) != size or said not in (None, digest(body))):
                raise ValueError("payload digest differs")
            said = said or digest(body)
        return (own(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, said, kind, own(fields.get("warc-refers-to"))) + (body if kind != "revisit" else None,) * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _open(path)
                with system.open_input_file(place) as file:
                    rows: list[tuple] = []
                    held = 0
                    for fields, block in records(ZipReader(file, file.size())):
                        rows.append(row(fields, block))
                        held += len(block) * with_payload
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "record string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    paths = manifest.select("path")
    return paths.repartition(max(1, min(paths.count(), MOST_READERS))).mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, **options) -> DataFrame:
    """Write the pages and read them back."""
    manifest = write_archives(pages, folder or scratch_path(pages.sparkSession, "warc"), id_col, url_col, payload_col, **options)
    kind = pages.schema[id_col].dataType.simpleString()
    got = read_archives(manifest, with_payload=False)
    return got.select(F.col("record").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
