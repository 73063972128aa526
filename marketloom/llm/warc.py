"""WARC records of pages in ZIP archives, written by tasks and read back by range without extraction.

An archive is a ZIP file whose members are stored, not deflated: `archive/data.warc.gz` with one gzip member for each
record, `indexes/index.cdxj` with a line for each record (sorted by reversed host and path) and `datapackage.json`. A page
is a `response` record whose block is an HTTP answer with the html in UTF-8. Of pages with equal payloads the one with the
largest page_id is the response; the others are `revisit` records that refer to it and hold the HTTP header alone, whose
Content-Length and whose digest are those of the full payload.

Reading takes a table of paths. Each archive's end record, ZIP64 locator and central directory are read, then its index
members; each index line gives the place of a record in the file. Places are dealt by (path, stretch of `STRETCH` bytes),
so one archive of any size is read by many tasks, and neighbouring records are fetched in one range read. Archive members
that no index names are walked gzip member by gzip member; deflated ones can't be read by range and are an error.

Defined results: a null html is an empty payload, and empty payloads are equal to each other; a null page_id is least and
is carried as null; of rows that repeat page_id and html one is the response and the others refer to it; a null url leaves
out the target, characters that can't stand in a header line are percent-encoded; an empty table writes no archive and
reads no record; other columns are ignored. Chunked transfer coding of foreign archives is not undone.

Scale: pages are copied once with a number of each row, so that a lost executor can't change which row of a tie is the
response. Groups of equal payloads are found on digests alone. Groups of at least rows / `HOT_GROUPS` pages (and `HOT_LEAST`), at
most `HOT_GROUPS` of them, are sent to all tasks; Catalyst joins the rest by the size of their table. An archive is closed at
`ARCHIVE_BYTES`, so a task holds one index of that many bytes of records and one page. Files of failed attempts are named
by no manifest and stay unread.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import partitions, settle, shared_folder

ARCHIVE_BYTES = 256 << 20
STRETCH = 64 << 20
READ_BYTES, GAP = 4 << 20, 1 << 16  # one range read: its size, and the gap between records that is read along
HOT_GROUPS, HOT_LEAST = 50_000, 10_000
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END, _END64, _LOCATOR, _ENTRY = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
_UNSAFE = re.compile(r"[^\x21-\x7E]")


# writing


def _header(lines: list[tuple[str, str]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in lines), "", ""]).encode()


def _uri(url: str | None) -> str | None:
    """`url` fit for a header line."""
    return None if url is None else _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url)


def _sort_key(uri: str | None) -> str:
    """Host labels reversed, then path and query, as indexes of archives are sorted."""
    try:
        parts = urlsplit(uri or "")
        host = parts.hostname or ""
    except ValueError:
        return uri or "-"
    return f"{','.join(reversed(host.split('.')))}){parts.path}{'?' + parts.query if parts.query else ''}".lower() if host else (uri or "-")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, serial: str, captured: str) -> bytes:
    """One WARC record, uncompressed; a revisit if it refers to another."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if refers_to else http + payload
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page_id, digest, serial if refers_to else None)), ("WARC-Date", captured)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields, "WARC/1.1") + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str, serial: str | None = None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{'' if serial is None else ':' + serial}>"


class _Archive:
    """One archive that is being written; records go straight to the file, index lines wait until it is closed."""

    def __init__(self, filesystem: FileSystem, path: str, captured: str):
        self.out = filesystem.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.size, self.lines, self.hash = 0, [], hashlib.sha256()
        self.captured = captured
        self.add(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", captured), ("Content-Type", "application/warc-fields"), ("Content-Length", "18")], "WARC/1.1") + b"format: WARC/1.1\r\n\r\n\r\n")

    def add(self, raw: bytes, uri: str | None = None, digest: str | None = None, kind: str | None = None) -> None:
        pack = zlib.compressobj(3, zlib.DEFLATED, 31)
        data = pack.compress(raw) + pack.flush()
        if kind:
            about = {"url": uri, "mime": "text/html" if kind == "response" else "warc/revisit", "status": "200", "digest": f"sha1:{digest}", "offset": str(self.size), "length": str(len(data)), "filename": "data.warc.gz"}
            self.lines.append(f"{_sort_key(uri).replace(' ', '%20')} {re.sub('[^0-9]', '', self.captured)} {json.dumps(about)}\n")
        self.member.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        self.member.close()
        index = "".join(sorted(self.lines)).encode()
        with self.zip.open("indexes/index.cdxj", "w", force_zip64=True) as member:
            member.write(index)
        parts = [("archive/data.warc.gz", self.hash.hexdigest(), self.size), ("indexes/index.cdxj", hashlib.sha256(index).hexdigest(), len(index))]
        about = {"profile": "data-package", "wacz_version": "1.1.1", "created": self.captured, "resources": [{"name": p.split("/")[1], "path": p, "hash": f"sha256:{h}", "bytes": n} for p, h, n in parts]}
        self.zip.writestr("datapackage.json", json.dumps(about))
        self.zip.close()
        self.out.close()


def _decided(pages: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, html, sha, uid, first): first is the struct of the group's response; null where a payload stands once."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    numbered = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha"), F.monotonically_increasing_id().alias("uid"))
    numbered.write.parquet(f"{folder}/pages")
    numbered = spark.read.parquet(f"{folder}/pages")
    groups = numbered.groupBy("sha").agg(F.max(F.struct("page_id", "uid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups.write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    hot = max(HOT_LEAST, numbered.count() // HOT_GROUPS)
    sent = numbered.join(F.broadcast(groups.where(F.col("n") >= hot).select("sha", F.col("first").alias("hot_first"))), "sha", "left")
    # pages of hot groups are settled; a key of their own deals them evenly if the rest is shuffled
    sent = sent.withColumn("key", F.when(F.col("hot_first").isNull(), F.col("sha")).otherwise(F.unhex(F.sha1(F.concat("sha", F.col("uid").cast("string").cast("binary"))))))
    rest = groups.where(F.col("n") < hot).select(F.col("sha").alias("key"), F.col("first").alias("cold_first"))
    return sent.join(rest, "key", "left").select("page_id", "url", "html", "sha", "uid", F.coalesce("hot_first", "cold_first").alias("first"))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, captured: str = CAPTURED) -> DataFrame:
    """(path, records, bytes): one row for each archive written below `folder`, by default one in the shared folder."""
    folder = f"{folder or shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    decided = _decided(pages, folder)
    FileSystem.from_uri(folder)[0].create_dir(FileSystem.from_uri(f"{folder}/archives")[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = FileSystem.from_uri(f"{folder}/archives")
        archive, path, done = None, "", []

        def close():
            archive.close()
            done.append((f"{folder}/archives/{path}", len(archive.lines), archive.size))

        for batch in batches:
            for page_id, url, html, sha, uid, first in zip(*(batch.column(i) for i in range(6)), strict=True):
                if archive is not None and archive.size >= archive_bytes:
                    close()
                    archive = None
                if archive is None:
                    path = f"{uuid.uuid4().hex}.wacz"
                    archive = _Archive(filesystem, f"{root}/{path}", captured)
                page_id, url, uid, first, digest = page_id.as_py(), _uri(url.as_py()), uid.as_py(), first.as_py(), base64.b32encode(sha.as_py()).decode()
                refers = record_id(first["page_id"], digest) if first and first["uid"] != uid else None
                archive.add(record(page_id, url, (html.as_buffer() or b"") and html.as_buffer().to_pybytes(), digest, refers, str(uid), captured), url, digest, "revisit" if refers else "response")
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True) if done else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return settle(decided.mapInArrow(write, "path string, records long, bytes long"))


# reading


class Member(NamedTuple):
    name: str
    stored: bool
    size: int
    header_at: int


def directory(read: Callable[[int, int], bytes], size: int) -> list[Member]:
    """Members of a ZIP file of `size` bytes by its central directory, ZIP64 or not. `read` takes a place and a length."""
    at = max(0, size - 65557)  # the end record and the longest comment
    tail = read(at, size - at)
    end = tail.rfind(_END)
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut short")
    count, length, begin = struct.unpack_from("<HLL", tail, end + 10)
    before = tail[end - 20 : end] if end >= 20 else read(at + end - 20, 20) if at + end >= 20 else b""
    if before[:4] == _LOCATOR:
        record64 = read(struct.unpack_from("<Q", before, 8)[0], 56)
        if record64[:4] != _END64:
            raise ValueError("the ZIP64 locator points to no ZIP64 end record")
        count, length, begin = struct.unpack_from("<3Q", record64, 32)
    entries, place, out = read(begin, length), 0, []
    for _ in range(count):
        if entries[place : place + 4] != _ENTRY:
            raise ValueError("the central directory is cut short")
        flags, method = struct.unpack_from("<2H", entries, place + 8)
        packed, full, n, m, c = struct.unpack_from("<2L3H", entries, place + 20)
        header_at = struct.unpack_from("<L", entries, place + 42)[0]
        name = entries[place + 46 : place + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, place = entries[place + 46 + n : place + 46 + n + m], place + 46 + n + m + c
        while len(extra) >= 4:
            kind, k = struct.unpack_from("<2H", extra)
            if kind == 1:  # 64-bit numbers stand here for those that are full in the entry, in this order
                wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header_at = next(wide) if header_at == 0xFFFFFFFF else header_at
            extra = extra[4 + k :]
        if flags & 1:
            raise ValueError(f"{name} is encrypted")
        out.append(Member(name, method == 0, packed, header_at))
    return out


def data_at(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where the bytes of a member begin."""
    name, extra = struct.unpack("<2H", read(member.header_at + 26, 4))
    return member.header_at + 30 + name + extra


def _index_lines(read: Callable[[int, int], bytes], member: Member) -> Iterator[dict]:
    """Entries of an index member, fetched and inflated piece by piece."""
    at, end = data_at(read, member), member.size
    pipes = ([] if member.stored else [zlib.decompressobj(-15)]) + ([zlib.decompressobj(31)] if member.name.endswith(".gz") else [])
    rest = b""
    for step in range(0, end, READ_BYTES):
        data = read(at + step, min(READ_BYTES, end - step))
        for i, pipe in enumerate(pipes):
            out = pipe.decompress(data)
            while pipe.eof and pipe.unused_data and pipe is pipes[-1] and member.name.endswith(".gz"):
                more = pipe.unused_data
                pipe = pipes[i] = zlib.decompressobj(31)
                out += pipe.decompress(more)
            data = out
        lines = (rest + data).split(b"\n")
        rest = lines.pop()
        yield from (json.loads(x[x.index(b"{") :]) for x in lines if b"{" in x)
    if b"{" in rest:
        yield json.loads(rest[rest.index(b"{") :])


def _walk(read: Callable[[int, int], bytes], begin: int, size: int, packed: bool) -> Iterator[tuple[int, int]]:
    """Place and length of each record of an archive member that no index names."""
    at = 0
    while at < size:
        if packed:
            pipe, used = zlib.decompressobj(31), 0
            while not pipe.eof:
                data = read(begin + at + used, min(READ_BYTES, size - at - used))
                if not data:
                    raise ValueError("a record is cut short")
                used += len(data)
                while data and not pipe.eof:
                    pipe.decompress(data, READ_BYTES)
                    data = pipe.unconsumed_tail
            used -= len(pipe.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                more = read(begin + at + len(head), min(1 << 14, size - at - len(head)))
                if not more:
                    raise ValueError("a record is cut short")
                head += more
            lines = head[: head.index(b"\r\n\r\n")].decode("utf-8", "replace").split("\r\n")
            used = head.index(b"\r\n\r\n") + 8 + int(_fields(lines)["content-length"])
        yield at, used
        at += used


def _opened(path: str) -> tuple[Callable[[int, int], bytes], int]:
    filesystem, name = FileSystem.from_uri(path)
    file = filesystem.open_input_file(name)

    def read(at: int, length: int) -> bytes:
        return file.read_at(length, at)

    return read, file.size()


def locate(paths: DataFrame) -> DataFrame:
    """(path, place, length, packed): where the records of the archives in column `path` stand in their files."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = _places(path)
                while some := [r for _, r in zip(range(10_000), rows)]:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), *(pa.array([r[i] for r in some]) for i in range(3))], ["path", "place", "length", "packed"])

    dealt = paths.where("path is not null").select(F.col("path").cast("string").alias("path")).distinct().repartition(partitions(paths.sparkSession), "path")
    return dealt.mapInArrow(find, "path string, place long, length long, packed boolean")


def _places(path: str) -> Iterator[tuple[int, int, bool]]:
    read, size = _opened(path)
    members = directory(read, size)
    archives = {m.name: m for m in members if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))}
    begins = {}
    for name, m in archives.items():
        if not m.stored:
            raise ValueError(f"{path}: {name} is deflated and can't be read by range")
        begins[name] = data_at(read, m)
    named = set()
    for m in members:
        if m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            for line in _index_lines(read, m):
                name = f"archive/{line['filename'].removeprefix('archive/')}"
                named.add(name)
                yield begins[name] + int(line["offset"]), int(line["length"]), name.endswith(".gz")
    for name in archives.keys() - named:
        packed = name.endswith(".gz")
        yield from ((begins[name] + at, length, packed) for at, length in _walk(read, begins[name], archives[name].size, packed))


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(raw: bytes) -> dict:
    """Fields of one uncompressed record. Digest and size are taken from the payload, in revisits from the headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head.decode("utf-8", "replace").split("\r\n"))
    block = rest[: int(fields.get("content-length", 0))]
    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    http, payload = {}, block
    if fields.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(top.decode("latin-1").split("\r\n"))
    found = None if kind == "revisit" else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    size = int(http["content-length"]) if kind == "revisit" and http.get("content-length", "").isdigit() else len(payload)
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"), "payload_bytes": size, "payload_digest": found or stated, "sound": stated is None or found is None or found == stated, "payload": None if kind == "revisit" else payload,
    }


RECORD = "path string, place long, record_type string, record_id string, refers_to string, target_uri string, date string, payload_bytes long, payload_digest string, sound boolean, payload binary"


def read_records(located: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at the places that `locate` found; `sound` is false where a payload is not the one its digest names."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read, out, held = None, None, [], 0
        for run in _runs(batches):
            if run[0][0] != path:
                path = run[0][0]
                read = _opened(path)[0]
            begin = run[0][1]
            data = read(begin, max(r[1] + r[2] for r in run) - begin)
            for _, place, length, packed in run:
                raw = data[place - begin : place - begin + length]
                row = {"path": path, "place": place, **parse(zlib.decompress(raw, 31) if packed else raw)}
                held += row["payload_bytes"] if payloads else 0
                if not payloads:
                    row["payload"] = None
                out.append(row)
                if held >= READ_BYTES or len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=kinds)

    simple = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = pa.schema([(n, simple[k]) for n, k in (x.split() for x in RECORD.split(", "))])
    dealt = located.withColumn("stretch", F.expr(f"place div {STRETCH}")).repartition(partitions(located.sparkSession), "path", "stretch")
    return dealt.sortWithinPartitions("path", "place").select("path", "place", "length", "packed").mapInArrow(fetch, RECORD)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Neighbouring records of one file that one range read fetches."""
    run, end = [], 0
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run and (r[0] != run[0][0] or r[1] - end > GAP or r[1] + r[2] - run[0][1] > READ_BYTES):
                yield run
                run, end = [], 0
            run.append(r)
            end = max(end, r[1] + r[2])
    if run:
        yield run


def digest(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): the pages among the records, by page_id."""

    def page(name: str):
        return F.regexp_extract(name, "^<urn:page:(-?[0-9]*):", 1).try_cast("long")

    pages = records.where(F.col("record_type").isin("response", "revisit") & F.col("record_id").startswith("<urn:page:"))
    return pages.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"), "sound")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
d as (select *, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) & 31)::int, 1), '' order by i) from range(32) r(i)) as digest,
  max(page_id) over (partition by h) as first, row_number() over (partition by h order by page_id desc nulls last) as nth from p)
select page_id, octet_length(encode(html))::bigint as payload_bytes, digest as payload_digest, case when nth = 1 then 'response' else 'revisit' end as record_type,
  case when nth > 1 then first end as refers_to, true as sound
from d
"""
