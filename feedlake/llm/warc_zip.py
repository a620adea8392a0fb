"""WARC records in ZIP packages: written from page tables, read back by ranges without extraction.

A package holds stored (not compressed) members: ``archive/*.warc.gz``, one gzip member for each record,
and ``indexes/index.cdxj``, one line for each record with its offset and length.  The reader takes the
package's end, its central directory and, where sizes ask for it, the ZIP64 directory; finds where the
archive members' bytes start; takes records' ranges from the index, or by walking the gzip members where
there is none; and reads the records of a range with one request.  Records are spread over tasks by
ranges, so one large package isn't one task's.

Of rows with equal payloads of at least ``smallest`` bytes the one with the largest page_id (null least,
then the last row read) is a response record and the others are revisits of it; shorter payloads are all
responses.  The payload is the html in UTF-8, null as empty.  A null page_id is kept as null, a null url
as the record's own name; line breaks and blanks in a url are percent-encoded; repeated rows are records
of their own; extra columns are ignored; an empty table makes no package.

Files go through pyarrow's file systems, so the folder may be local, shared or an object store.  A task
that runs again writes under a new name, and only files named in the written manifest are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.shared import map_arrow, materialise, new_path, partitions

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
PACKAGE_BYTES = 128 << 20
RANGE_BYTES = 4 << 20


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    path = re.sub("^file:/+", "/", path)
    return (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, kind: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_name(page_id: int | None) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


class Package:
    """A ZIP package being written: records first, then their index."""

    def __init__(self, folder: str):
        files, path = file_system(folder)
        files.create_dir(path, recursive=True)
        self.path = f"{folder}/pages-{uuid.uuid4().hex}.wacz"
        self.zip = zipfile.ZipFile(files.open_output_stream(file_system(self.path)[1]), "w", zipfile.ZIP_STORED)
        self.stream = self.zip.fp
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, name: str, kind: str, url: str | None, payload: bytes, refers_to: str | None) -> None:
        packed = gzip.compress(record(name, kind, url, payload, refers_to), 1, mtime=0)
        self.member.write(packed)
        self.lines.append(f"{name} {DATE} {json.dumps({'offset': self.size, 'length': len(packed), 'filename': 'data.warc.gz'})}\n")
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr("indexes/index.cdxj", "".join(sorted(self.lines)))
        self.zip.close()
        getattr(self.stream, "fp", self.stream).close()
        return self.path, len(self.lines)


def write_packages(pages: DataFrame, folder: str, smallest: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for every row of page_id, url, html; gives the manifest: path, records."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = materialise(
        pages.select(F.monotonically_increasing_id().alias("row_id"), F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload")), "warc-rows"
    )
    named = materialise(rows.select("row_id", "page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")), "warc-named")
    last = named.where(F.col("size") >= smallest).groupBy("sha", "size").agg(F.max(F.struct("page_id", "row_id")).alias("last"))
    kinds = named.join(materialise(last, "warc-last"), ["sha", "size"], "left").select(
        "row_id", F.coalesce(F.col("last.row_id") == F.col("row_id"), F.lit(True)).alias("response"), F.col("last.page_id").alias("refers_to")
    )

    def write(batches):
        package, done = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "response", "refers_to")]
            for page_id, url, payload, response, refers_to in zip(*columns):
                package = package or Package(folder)
                kind = "response" if response.as_py() else "revisit"
                package.add(page_name(page_id.as_py()), kind, url.as_py(), payload.as_py(), page_name(refers_to.as_py()))
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    joined = rows.join(kinds.hint("shuffle_hash"), "row_id").select("page_id", "url", "payload", "response", "refers_to")
    return materialise(joined.transform(map_arrow, write, "path string, records bigint"), "warc-manifest")


# --- reading ------------------------------------------------------------------------------------


class Member:
    """A stored member of a package, by name and place."""

    def __init__(self, name: str, method: int, size: int, header: int):
        self.name, self.method, self.size, self.header = name, method, size, header


def directory(f: pa.NativeFile) -> list[Member]:
    """The members that a package's central directory names, ZIP64 or not."""
    size = f.size()
    tail_at = max(0, size - 65_557)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end + 3)
    if end < 0:
        raise ValueError("not a ZIP package: its end record is missing")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if tail[end - 20 : end - 16] == b"PK\x06\x07":
        record_at = struct.unpack_from("<Q", tail, end - 12)[0]
        wide = f.read_at(56, record_at)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is missing")
        count, length, at = struct.unpack_from("<QQQ", wide, 32)
    elif 0xFFFFFFFF in (length, at) or count == 0xFFFF:
        raise ValueError("the ZIP64 locator is missing")
    central, members, i = f.read_at(length, at), [], 0
    for _ in range(count):
        if central[i : i + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is cut short")
        flags, method = struct.unpack_from("<HH", central, i + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", central, i + 20)
        header = struct.unpack_from("<I", central, i + 42)[0]
        name = central[i + 46 : i + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = central[i + 46 + n_name : i + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                field = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(field) if plain == 0xFFFFFFFF else plain
                packed = next(field) if packed == 0xFFFFFFFF else packed
                header = next(field) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        members.append(Member(name, method, packed, header))
        i += 46 + n_name + n_extra + n_comment
    return members


def data_start(f: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed: only stored members can be read by ranges")
    local = f.read_at(30, member.header)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def indexed_ranges(f: pa.NativeFile, members: list[Member]) -> Iterator[tuple[int, int]]:
    """Places in the file (offset, length) of all records of a package."""
    archives = {m.name.rsplit("/", 1)[-1]: m for m in members if re.search(r"\.warc(\.gz)?$", m.name)}
    found = set()
    starts = {name: data_start(f, m) for name, m in archives.items()}
    for m in members:
        if re.search(r"\.cdxj?$", m.name):
            for line in f.read_at(m.size, data_start(f, m)).decode().splitlines():
                if "{" in line:
                    entry = json.loads(line[line.index("{") :])
                    if entry.get("filename") in starts:
                        found.add(entry["filename"])
                        yield starts[entry["filename"]] + int(entry["offset"]), int(entry["length"])
    for name, m in archives.items():
        if name not in found and m.size:
            yield from walked_ranges(f, starts[name], m.size)


def walked_ranges(f: pa.NativeFile, start: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Records of an archive without index: where its gzip members begin and end."""
    at, end, begun, inflate, held = start, start + size, start, zlib.decompressobj(31), b""
    while at < end or held:
        if not held:
            held = f.read_at(min(step, end - at), at)
            at += len(held)
        inflate.decompress(held)
        held = inflate.unused_data
        if inflate.eof:
            yield begun, at - len(held) - begun
            begun, inflate = at - len(held), zlib.decompressobj(31)


def _ranges(batches):
    """Runs of adjacent records of about RANGE_BYTES: where they start, and their lengths."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, name = file_system(path)
            out: list[tuple[int, list[int]]] = []
            with files.open_input_file(name) as f:
                run, size = None, 0
                for offset, length in sorted(indexed_ranges(f, directory(f))):
                    if run is None or offset != run[0] + size or size + length > RANGE_BYTES:
                        run, size = (offset, []), 0
                        out.append(run)
                    run[1].append(length)
                    size += length
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(out), pa.string()), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.list_(pa.int64()))], ["path", "offset", "lengths"]
            )


def parsed(raw: bytes) -> dict:
    """A record's headers, its payload's size and digest, and its payload."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    name = lambda v: v.strip("<>") if v else None
    out = {"record_id": name(headers["warc-record-id"]), "record_type": headers["warc-type"], "target_uri": headers.get("warc-target-uri"), "refers_to": name(headers.get("warc-refers-to"))}
    if headers["warc-type"] == "revisit":
        return out | {"payload_bytes": int(told["content-length"]), "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"), "payload": None}
    found = digest(payload)
    if headers.get("warc-payload-digest", f"sha1:{found}") != f"sha1:{found}" or int(told.get("content-length", len(payload))) != len(payload):
        raise ValueError(f"record {out['record_id']} is damaged")
    return out | {"payload_bytes": len(payload), "payload_digest": found, "payload": payload}


RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"
_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_packages(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the packages in the manifest's ``path``."""

    def read(batches):
        for batch in batches:
            for path, offset, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "lengths"))):
                files, name = file_system(path)
                with files.open_input_file(name) as f:
                    run = f.read_at(sum(lengths), offset)
                at, rows = 0, []
                for length in lengths:
                    rows.append(parsed(gzip.decompress(run[at : at + length])) | ({} if payloads else {"payload": None}))
                    at += length
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    ranges = manifest.select("path").repartition(partitions(spark), "path").transform(map_arrow, _ranges, "path string, offset bigint, lengths array<bigint>")
    return ranges.repartition(partitions(spark), "path", "offset").transform(map_arrow, read, RECORDS)


def round_trip(pages: DataFrame, smallest: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write all pages and read the records back, without their payloads."""
    spark = pages.sparkSession
    manifest = write_packages(pages, new_path(spark, "warc"), smallest, package_bytes)
    return read_packages(spark, manifest, payloads=False)


def page_id_of(name):
    return F.regexp_extract(name, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
