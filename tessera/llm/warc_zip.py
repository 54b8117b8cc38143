"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package is a ZIP file with two stored members, ``archive/data.warc.gz`` (each record a gzip member of its own, so it can be read alone) and
``indexes/index.cdxj`` (a line per record: key, place, length). The reader
finds the end-of-central-directory record at the tail, follows the ZIP64 locator where a field is saturated, walks the central directory, takes the data
start of a stored member from its local header, reads the index by its range, and then reads record ranges in batches that other tasks can share.

Files are opened through pyarrow's file systems, so a package can lie in any store they know. Each attempt of a task writes packages of its own names
and only the manifest of the attempt that succeeded is read, so a lost executor leaves at most an unused file.

Defined results: null html and url are empty; a null page_id is never another page's original and its page is a response; of repeated rows with one
page_id and payload each is a response or each a revisit; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, written

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_FULL = 0xFFFFFFFF
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing


def record(page_id: int | None, url: str, payload: bytes, digest: str, original: int | None) -> bytes:
    """One WARC record; with an original it is a revisit without payload."""
    name = "" if page_id is None else str(page_id)
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if original is None else b"revisit"),
        b"WARC-Record-ID: <urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{name}:{url}")).encode() + b">",
        b"WARC-Date: 2024-01-01T00:00:00Z",
        b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"X-Page-Id: " + name.encode(),
        b"X-Payload-Length: " + str(len(payload)).encode(),
    ]
    if original is not None:
        head += [b"WARC-Profile: " + REVISIT.encode(), b"WARC-Refers-To-Page: " + str(original).encode()]
    block = HTTP + (payload if original is None else b"")
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; zip64 writes all sizes and places in ZIP64 fields."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        place, size, crc, raw = len(out), len(data), zlib.crc32(data), name.encode()
        big = zip64 or size >= _FULL or place >= _FULL
        local_extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        extra = struct.pack("<HHQQQ", 1, 24, size, size, place) if big else b""
        shown = _FULL if big else size
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(local_extra)) + raw + local_extra + data
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, _FULL if big else place) + raw + extra
    at, n = len(out), len(members)
    out += central
    if zip64 or at >= _FULL or n >= 0xFFFF:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(central), at) + struct.pack("<IIQI", 0x07064B50, 0, end, 1)
        out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, _FULL, _FULL, 0)
    else:
        out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, len(central), at, 0)
    return bytes(out)


# Reading


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def _read(f: pa.NativeFile, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def central_directory(f: pa.NativeFile) -> dict[str, Member]:
    """Members by name; of a name that occurs twice the last."""
    size = f.size()
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = _read(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):  # the signature within a comment
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    _, _, n, length, at = struct.unpack("<HHxxHII", tail[end + 4 : end + 20])
    if n == 0xFFFF or length == _FULL or at == _FULL:
        locator = _read(f, tail_at + end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("ZIP64 locator is missing")
        fields = struct.unpack("<IQHHIIQQQQ", _read(f, struct.unpack("<Q", locator[8:16])[0], 56))
        if fields[0] != 0x06064B50:
            raise ValueError("ZIP64 end of central directory is missing")
        n, length, at = fields[7:10]
    data, p, out = _read(f, at, length), 0, {}
    for _ in range(n):
        sign, _, _, flags, method, _, _, _, packed, full, a, b, c, _, _, _, header = struct.unpack("<IHHHHHHIIIHHHHHII", data[p : p + 46])
        if sign != 0x02014B50:
            raise ValueError("central directory is damaged")
        name, extra = data[p + 46 : p + 46 + a], data[p + 46 + a : p + 46 + a + b]
        q = 0
        while q + 4 <= len(extra):
            kind, m = struct.unpack("<HH", extra[q : q + 4])
            if kind == 1:
                values = iter(struct.unpack(f"<{m // 8}Q", extra[q + 4 : q + 4 + m // 8 * 8]))
                full = next(values) if full == _FULL else full
                packed = next(values) if packed == _FULL else packed
                header = next(values) if header == _FULL else header
            q += 4 + m
        key = name.decode("utf-8" if flags & 0x800 else "cp437")
        out[key] = Member(key, method, full, packed, header)
        p += 46 + a + b + c
    return out


def data_start(f: pa.NativeFile, member: Member) -> int:
    """Place of a stored member's first byte."""
    if member.method != 0 or member.size != member.packed:
        raise ValueError(f"{member.name} is not stored, its records can't be read by range")
    head = _read(f, member.header, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("local header is damaged")
    a, b = struct.unpack("<HH", head[26:30])
    return member.header + 30 + a + b


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, block = data.split(b"\r\n\r\n", 1)
    fields = dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:]))
    return fields, block[: int(fields["content-length"])]


# On Spark

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def with_originals(pages: DataFrame, min_bytes: int = 0, broadcast_rows: int = 200_000, salts: int = 64) -> DataFrame:
    """pages(page_id, url, html) with payload digest and, for a repeat of a payload of at least min_bytes bytes, the page that holds it: of the equal
    ones that with the largest page_id."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    repeats = rows.groupBy("sha1").agg(F.max("page_id").alias("_largest"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    repeats = written(repeats, "repeated-payloads")
    if repeats.count() <= broadcast_rows:
        found = rows.join(F.broadcast(repeats), "sha1", "left")
    else:  # the pages of one payload are dealt to many tasks
        spread = repeats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["sha1", "_salt"], "left")
    repeat = (F.octet_length("payload") >= min_bytes) & (F.col("page_id") < F.col("_largest"))
    return found.select("page_id", "url", "payload", F.when(repeat, F.col("_largest")).alias("original"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, max_bytes: int = 32 << 20, zip64: bool = True, level: int = 3) -> DataFrame:
    """Write all pages into packages under the folder; the manifest of what was written, itself a written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        data, lines = bytearray(), []

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            made = package([(WARC, bytes(data)), (INDEX, "".join(lines).encode())], zip64)
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(made)
            row = [[f"{folder}/{name}"], [len(lines)], [len(made)]]
            data.clear(), lines.clear()
            return pa.record_batch([pa.array(row[0]), pa.array(row[1]), pa.array(row[2])], names=["path", "records", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, original = (batch.column(c)[i].as_py() for c in range(4))
                made = gzip.compress(record(page_id, url, payload, base32_sha1(payload), original), level, mtime=0)
                lines.append(f"{'' if page_id is None else page_id} {len(data)} {len(made)}\n")
                data += made
                if len(data) >= max_bytes:
                    yield close()
        if lines:
            yield close()

    return written(with_originals(pages, min_bytes).mapInArrow(work, MANIFEST), "manifest")


def record_ranges(manifest: DataFrame, per_range: int = 2000) -> DataFrame:
    """The index of every package, as ranges of so many records: (path, places, lengths), places within the file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    members = central_directory(f)
                    start, index = data_start(f, members[WARC]), members[INDEX]
                    lines = _read(f, data_start(f, index), index.size).decode().splitlines()
                at = [[int(x) for x in line.split(" ")[1:]] for line in lines]
                for k in range(0, len(at), per_range):
                    part = at[k : k + per_range]
                    ints = pa.list_(pa.int64())
                    yield pa.record_batch([pa.array([path]), pa.array([[start + p for p, _ in part]], ints), pa.array([[n for _, n in part]], ints)], names=["path", "places", "lengths"])

    return manifest.select("path").mapInArrow(work, "path string, places array<long>, lengths array<long>")


def read_records(ranges: DataFrame, with_payload: bool = True, max_bytes: int = 32 << 20) -> DataFrame:
    """One row per record, read by its range; about max_bytes of payloads are held at once. The payload of a response is checked against its digest."""
    schema = RECORDS if with_payload else RECORDS.rsplit(", ", 1)[0]
    names = [x.split() for x in schema.split(", ")]

    def rows_of(cols: list[list]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names, strict=True)], names=[n for n, _ in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = pafs.FileSystem.from_uri(row["path"])
                out: list[list] = [[] for _ in schema.split(", ")]
                held = 0
                with fs.open_input_file(name) as f:
                    for place, length in zip(row["places"], row["lengths"], strict=True):
                        fields, block = parse_record(gzip.decompress(_read(f, place, length)))
                        payload = block.split(b"\r\n\r\n", 1)[1]
                        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        size = int(fields["x-payload-length"])
                        if kind == "response" and (base32_sha1(payload) != digest or len(payload) != size):
                            raise ValueError(f"payload of page {fields['x-page-id']} doesn't match its digest")
                        refers = fields.get("warc-refers-to-page")
                        page = fields["x-page-id"]
                        values = (int(page) if page else None, fields["warc-target-uri"], kind, size, digest, int(refers) if refers else None, payload)
                        for col, value in zip(out, values):
                            col.append(value)
                        held += len(payload) if with_payload else 0
                        if held >= max_bytes:
                            yield rows_of(out)
                            out, held = [[] for _ in out], 0
                if out[0]:
                    yield rows_of(out)

    return ranges.mapInArrow(work, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0, per_range: int = 1000) -> DataFrame:
    """Write pages into packages in the shared folder and read their records back."""
    spark = pages.sparkSession
    manifest = write_archives(pages, fresh_path(spark, "warc"), min_bytes)
    tasks = max(1, spark.sparkContext.defaultParallelism)
    records = manifest.agg(F.sum("records")).first()[0] or 0
    ranges = record_ranges(manifest.repartition(tasks), per_range)
    return read_records(ranges.repartition(max(tasks, records // (8 * per_range))), with_payload=False)
