"""WARC records in ZIP packages, read back by range.

Each writing task packs its pages into ZIP archives with two stored members: ``archive/data.warc.gz``, in which every
record is a gzip member of its own, and ``indexes/index.cdxj``, which gives offset and length of every record. The reader never unpacks: it parses the end
record, the ZIP64 records where there are any, and the central directory, finds the stored members, reads the indexes,
and fetches single records by offset. An archive without an index is
walked record by record, and plain ``.warc`` members are read as well.

Of pages with equal payloads of ``REVISIT_BYTES`` or more, the one with the largest identifier is a response and the
others are revisits of it, without payload.

Scale: payloads are grouped by digest counts that combine before their shuffle; one payload with a third of all rows
is a skewed join side that Spark splits. Archives are closed at a set size, so index and memory of a task are bounded.
Archives have fresh names; only those in the table that successful tasks wrote are read, so a lost or repeated
task leaves nothing behind that counts.

Packages of others: names of fields are taken in any letter case, folded lines are joined, index offsets may be texts, index lines
without a place are passed over, and an index names the data member it is about where there are several. Records of other
types (warcinfo, request, metadata) come out with their type. ``record_id`` is the identifier as written; ``page_id`` and
``refers_to`` are null where that is not one of ours. Digests in base 32 become hexadecimal. The size of a revisit's payload is null where
its record does not tell it. Transfer encodings inside a payload are left as they are.

Defined results: a null payload is empty; a null url has no target header. Null identifiers rank below all others. Rows
that repeat the largest identifier of their payload are responses each. No pages give no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgrain.llm.common import text_or_empty
from hitgrain.session import stage_table, work_dir

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 128 << 20
GZIP_LEVEL = 3
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Bytes of records that one task reads at the least, and those that always go to the same task.
READ_BYTES, SLICE_BYTES = 64 << 20, 1 << 20
PLACES = 100_000
ARCHIVES = "path string, bytes long, records long"
DIGEST = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"
NAME = "urn:page:"


def record_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` and ``refers_to`` (null for responses) of every page."""
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        text_or_empty(F.col(f"`{html}`")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha2("payload", 256))
    rows = rows.withColumn("_same", large)
    groups = (
        rows.filter("_same is not null")
        .groupBy("_same")
        .agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_many"))
        .filter("_many > 1")
        .drop("_many")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return rows.join(groups, "_same", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{NAME}{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """One ZIP archive with its records and their index."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        fs, path = pafs.FileSystem.from_uri(self.path) if "://" in folder else (pafs.LocalFileSystem(), self.path)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self._stream = fs.open_output_stream(path)
        self._zip = zipfile.ZipFile(self._stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self._data = self._zip.open(DATA, "w", force_zip64=True)
        self._index = io.BytesIO()
        self.bytes = self.records = 0

    def add(self, name: str, record: bytes) -> None:
        self._data.write(record)
        self._index.write(f"{name} {json.dumps({'offset': self.bytes, 'length': len(record)})}\n".encode())
        self.bytes += len(record)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self._data.close()
        self._zip.writestr(INDEX, self._index.getvalue())
        self._zip.close()
        self._stream.close()
        return self.path, self.bytes, self.records


def _packed(folder: str, limit: int):
    def pack(batches):
        archive, closed = None, []
        for batch in batches:
            for row in zip(*(batch[name].to_pylist() for name in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                page_id, url, payload, digest, refers_to = row
                archive = archive or ArchiveWriter(folder)
                record = record_bytes(page_id, url, payload.encode(), digest, refers_to)
                archive.add(f"{NAME}{page_id}", gzip.compress(record, GZIP_LEVEL, mtime=0))
                if archive.bytes >= limit:
                    closed.append(archive.close())
                    archive = None
        if archive:
            closed.append(archive.close())
        if closed:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "records"), row, strict=True)) for row in closed])

    return pack


def write_archives(pages: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ZIP archives of about ``limit`` bytes below ``folder``; the table of what was written."""
    return stage_table(record_types(pages).mapInArrow(_packed(folder, limit), ARCHIVES), "archives")


def open_archive(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


def read_at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def stored_members(file) -> dict[str, tuple[int, int]]:
    """Offset and length of every stored member's data, from the central directory."""
    size = file.size()
    tail_at = max(0, size - 65557)
    tail = read_at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, at):
        signature, _, end64, _ = struct.unpack("<IIQI", read_at(file, tail_at + end - 20, 20))
        if signature != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        count, length, at = struct.unpack_from("<QQQ", read_at(file, end64, 56), 32)
    directory, here, members = read_at(file, at, length), 0, {}
    for _ in range(count):
        method, packed, plain, name_len, extra_len, note_len, local = (
            *struct.unpack_from("<H", directory, here + 10),
            *struct.unpack_from("<IIHHH", directory, here + 20),
            *struct.unpack_from("<I", directory, here + 42),
        )
        name = directory[here + 46 : here + 46 + name_len].decode()
        extra = directory[here + 46 + name_len : here + 46 + name_len + extra_len]
        plain, packed, local = _wide(extra, plain, packed, local)
        here += 46 + name_len + extra_len + note_len
        if method == 0:
            head = read_at(file, local, 30)
            members[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), plain)
    return members


def _wide(extra: bytes, *values: int) -> list[int]:
    """Sizes and offset, taken from the ZIP64 field where the short form is all ones."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = extra[at + 4 : at + 4 + length]
        at += 4 + length
    out, used = [], 0
    for value in values:
        if value == 0xFFFFFFFF and used + 8 <= len(wide):
            value, used = struct.unpack_from("<Q", wide, used)[0], used + 8
        out.append(value)
    return out


def _index_places(file, indexes: list[tuple[int, int]], data: dict[str, tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Places by the index lines that have one; a line names its data member, or there is only one."""
    begins = {name.rpartition("/")[2]: begin for name, (begin, _) in data.items()}
    only = next(iter(begins.values())) if len(begins) == 1 else None
    for place in indexes:
        for line in read_at(file, *place).decode().splitlines():
            entry = json.loads(line[line.index("{") :]) if "{" in line else {}
            begin = begins.get(str(entry.get("filename", "")).rpartition("/")[2], only)
            if begin is not None and "offset" in entry and "length" in entry:
                yield begin + int(entry["offset"]), int(entry["length"])


def record_places(file) -> Iterator[tuple[int, int]]:
    """Offset in the archive and length of every record, by the indexes or else by the records' own lengths."""
    members = stored_members(file)
    data = {name: place for name, place in members.items() if name.endswith((".warc", ".warc.gz"))}
    indexes = [place for name, place in members.items() if name.endswith(".cdxj")]
    if indexes and data:
        yield from _index_places(file, indexes, data)
        return
    for name, (begin, length) in data.items():
        walk = _gzip_length if name.endswith(".gz") else _plain_length
        at = begin
        while at < begin + length:
            whole = walk(file, at)
            yield at, whole
            at += whole


def _gzip_length(file, at: int) -> int:
    """Length of the gzip member that begins at ``at``."""
    member, used = zlib.decompressobj(31), 0
    while not member.eof:
        more = read_at(file, at + used, 1 << 16)
        if not more:
            raise ValueError("record without end")
        member.decompress(more)
        used += len(more)
    return used - len(member.unused_data)


CONTENT_LENGTH = re.compile(rb"(?i)(?:^|\r\n)content-length[ \t]*:[ \t]*(\d+)")


def _plain_length(file, at: int) -> int:
    head = b""
    while b"\r\n\r\n" not in head:
        more = read_at(file, at + len(head), 4096)
        if not more:
            raise ValueError("record without end of head")
        head += more
    head = head[: head.index(b"\r\n\r\n") + 4]
    return len(head) + int(CONTENT_LENGTH.search(head)[1]) + 4


def head_fields(head: bytes) -> dict[str, str]:
    """Fields of a record's head by their names in lower case; a line that begins with white space goes on with the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def hex_digest(value: str) -> str:
    """The bare digest of a labelled one, in hexadecimal."""
    bare = value.rpartition(":")[2]
    if len(bare) == 32 and re.fullmatch("[A-Za-z2-7]+", bare):
        return base64.b32decode(bare.upper()).hex()
    return bare.lower()


def parse_record(record: bytes) -> tuple:
    """(page_id, payload bytes, payload digest, type, refers_to, record_id) of one record."""
    if record[:2] == b"\x1f\x8b":
        record = gzip.decompress(record)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = head_fields(head)
    block = rest[: int(fields["content-length"])] if "content-length" in fields else rest
    http, payload = b"", block
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    record_id, refers_to = (fields.get(name) for name in ("warc-record-id", "warc-refers-to"))
    kind = fields.get("warc-type")
    if kind == "revisit":
        size = CONTENT_LENGTH.search(http)
        digest = fields.get("warc-payload-digest")
        told = int(size[1]) if size else None, hex_digest(digest) if digest else None
        return page_number(record_id), *told, kind, page_number(refers_to), record_id
    return page_number(record_id), len(payload), hashlib.sha1(payload).hexdigest(), kind, None, record_id


def page_number(name: str | None) -> int | None:
    """The page of an identifier of ours; null for others."""
    bare = (name or "").strip("<>")
    number = bare.removeprefix(NAME)
    return int(number) if number != bare and re.fullmatch(r"-?\d+", number) else None


def _placed(batches):
    for batch in batches:
        for path in batch["path"].to_pylist():
            with open_archive(path) as file:
                places = record_places(file)
                while some := list(islice(places, PLACES)):
                    offsets, lengths = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(some)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                        names=["path", "offset", "length"],
                    )


def _read(batches):
    file, opened = None, None
    for batch in batches:
        rows = []
        for path, offset, length in zip(*(batch[name].to_pylist() for name in ("path", "offset", "length")), strict=True):
            if path != opened:
                file, opened = open_archive(path), path
            rows.append(parse_record(read_at(file, offset, length)))
        names = [part.split()[0] for part in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of all archives of a table with ``path``, each fetched by its place.

    Tasks go by the bytes of records, not by those of the places that name them: their number is that of all archives' bytes
    over ``READ_BYTES`` (where the table tells ``bytes``), two for each core at the least. Slices of an archive are dealt to them whole.
    """
    tasks = 2 * archives.sparkSession.sparkContext.defaultParallelism
    if "bytes" in archives.columns:
        tasks = max(tasks, (archives.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES)
    places = archives.select("path").repartition(tasks, "path").mapInArrow(_placed, "path string, offset long, length long")
    slices = F.call_function("div", F.col("offset"), F.lit(SLICE_BYTES))
    dealt = places.repartition(tasks, "path", slices).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(_read, RECORDS)


def packed_pages(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    return read_archives(write_archives(pages, work_dir(pages.sparkSession, "warc"))).select(*DIGEST)
