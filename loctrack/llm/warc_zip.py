"""WARC records in ZIP packages, read by ranges (operator 8).

``write_archives`` writes a WARC record for each page, gzipped one by one, into
stored members of ZIP64 packages, beside a stored index of the records.
``read_archives`` reads the end of a package, follows the ZIP64 locator, parses
the central directory, finds the index and the archive members, and reads each
record by its byte range; nothing is extracted.  Packages lie in the shared
folder and are reached through pyarrow's file systems; each has about
``PACKAGE_BYTES``, so a task holds one package's records at most, and a single
large page has a package of its own.

Of pages with equal payloads the largest page_id is a response and the others
are revisits of it; equality is that of SHA-1 and length, found by one
aggregation, and the join back to the pages can be split where many pages are
equal.  A package's name has the task attempt in it and only the packages of
finished tasks are listed, so a retried task leaves no record twice.

Defined cases: null html is an empty payload; null or odd URLs are escaped; rows
that share the largest page_id of their payload are all responses; a page
without page_id revisits if an equal payload has one, and is a response
otherwise; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loctrack.llm.common import new_path, slices, written

#: Bytes of records from which a package is closed.
PACKAGE_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 0
#: Packages that are read in one partition.
PACKAGES_PER_TASK = 4

# Fixed values of the ZIP and WARC formats.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


# ------------------------------------------------------------------ ZIP


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP64 package of stored members."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, at, size = name.encode(), len(out), len(data)
        fixed = struct.pack("<HHHHHIII", 45, 0x800, 0, 0, 0x21, zlib.crc32(data), FULL32, FULL32)
        out += LOCAL + fixed + struct.pack("<HH", len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, size, size) + data
        central += CENTRAL + struct.pack("<H", 45) + fixed + struct.pack("<HHHHHII", len(raw), 28, 0, 0, 0, 0, FULL32) + raw + struct.pack("<HHQQQ", 1, 24, size, size, at)
    start, n = len(out), len(members)
    end64 = start + len(central)
    out += central + END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(central), start)
    out += LOCATOR64 + struct.pack("<IQI", 0, end64, 1)
    return bytes(out + END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


def directory(file) -> dict[str, tuple[int, int]]:  # noqa: ANN001
    """Stored members of an open package: name to (first byte, length)."""
    size = file.size()
    tail_at = max(0, size - 22 - FULL16)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if FULL16 == n or FULL32 in (length, start):
        if tail[end - 20 : end - 16] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        record = file.read_at(56, at)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    listed, at, out = file.read_at(length, start), 0, {}
    for _ in range(n):
        if listed[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain = struct.unpack_from("<H", listed, at + 10)[0], *struct.unpack_from("<II", listed, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", listed, at + 28)
        offset = struct.unpack_from("<I", listed, at + 42)[0]
        name = listed[at + 46 : at + 46 + n_name].decode()
        extra, k = listed[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # the fields that didn't fit, in this order
                wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, k + 4))
                plain, packed, offset = (next(wide) if x == FULL32 else x for x in (plain, packed, offset))
            k += 4 + m
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        local = file.read_at(30, offset)
        if local[:4] != LOCAL:
            raise ValueError(f"{name} has no local header")
        out[name] = offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed
        at += 46 + n_name + n_extra + n_comment
    return out


# ------------------------------------------------------------------ WARC


def record_id(page_id: int | None) -> str:
    if page_id is None:
        return "<urn:uuid:ffffffff-0000-0000-0000-000000000000>"
    h = f"{page_id & (1 << 64) - 1:016x}"
    return f"<urn:uuid:00000000-0000-0000-{h[:4]}-{h[4:]}>"


def page_of(record: str | None) -> int | None:
    if record is None or record.startswith("<urn:uuid:f"):
        return None
    n = int(record.removesuffix(">")[-17:].replace("-", ""), 16)
    return n - (1 << 64) if n >> 63 else n


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which has no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=-._~')}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (in lower case), and the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    return fields, rest[: int(fields["content-length"])]


# ------------------------------------------------------------------ Spark


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to)."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").alias("size"))
    kept = rows.groupBy("sha1", "size").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("size") >= min_bytes)).drop("n")
    older = F.col("page_id").isNull() | (F.col("page_id") < F.col("newest"))
    return rows.join(kept, ["sha1", "size"], "left").select("page_id", "url", "payload", F.when(older, F.col("newest")).alias("refers_to"))


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write the records of (page_id, url, payload, refers_to) into packages
    under ``root``; a row (path, n_records, n_bytes) for each package."""

    def close(place: fs.FileSystem, top: str, k: int, parts: list[bytes], index: list[str]) -> tuple[str, int, int]:
        task = TaskContext.get()
        path = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{k}.wacz"
        data = zip_bytes([(DATA, b"".join(parts)), (INDEX, "".join(index).encode())])
        with place.open_output_stream(path) as out:
            out.write(data)
        return path, len(index), len(data)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = fs.FileSystem.from_uri(root)
        place.create_dir(top, recursive=True)
        done, parts, index, n = [], [], [], 0
        for batch in slices(batches, 200):
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = gzip.compress(record_bytes(page_id, url, payload, refers_to), 1, mtime=0)
                index.append(f"{quote(url or '', safe=':/?#=&')} {DATE} " + json.dumps({"offset": n, "length": len(raw), "filename": DATA, "record": record_id(page_id)}) + "\n")
                parts.append(raw)
                n += len(raw)
                if n >= PACKAGE_BYTES:
                    done.append(close(place, top, len(done), parts, index))
                    parts, index, n = [], [], 0
        if parts:
            done.append(close(place, top, len(done), parts, index))
        for path, records, size in done:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(tasks, "path string, n_records bigint, n_bytes bigint")


READ_SCHEMA = "path string, page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(packages: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the packages (path): page, URL, payload (null
    for revisits, and everywhere if not asked for), length and digest of the
    full payload, type, and the page it refers to.  A payload that doesn't have
    the digest that its record names is an error."""

    def one(file, path: str, at: int, length: int) -> dict:  # noqa: ANN001
        fields, block = parse_record(gzip.decompress(file.read_at(length, at)))
        http, _, body = block.partition(b"\r\n\r\n")
        named = fields["warc-payload-digest"].removeprefix("sha1:")
        response = fields["warc-type"] == "response"
        if response and digest(body) != named:
            raise ValueError(f"{path}: the record at byte {at} has another digest")
        size = len(body) if response else int(http.lower().rpartition(b"content-length:")[2])
        return {"path": path, "page_id": page_of(fields["warc-record-id"]), "url": unquote(fields["warc-target-uri"]), "payload": body if response and payloads else None, "payload_bytes": size, "payload_digest": named, "record_type": fields["warc-type"], "refers_to": page_of(fields.get("warc-refers-to"))}

    types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip([x.split()[0] for x in READ_SCHEMA.split(", ")], types, strict=True)))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with place.open_input_file(path) as file:
                    members = directory(file)
                    at, length = members[INDEX]
                    listed = [json.loads(x[x.index("{") :]) for x in file.read_at(length, at).decode().splitlines()]
                    for k in range(0, len(listed), 100):
                        rows = [one(file, path, members[x["filename"]][0] + x["offset"], x["length"]) for x in listed[k : k + 100]]
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return packages.select("path").mapInArrow(tasks, READ_SCHEMA)


def roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, payloads: bool = True) -> DataFrame:
    """Write all pages into packages of the shared folder and read them back."""
    root = new_path(pages.sparkSession, "warc")
    packages = written(write_archives(with_roles(pages, id_col, url_col, html_col, min_bytes), root), "packages")
    parts = max(1, packages.count() // PACKAGES_PER_TASK)
    return read_archives(packages.repartition(parts, "path"), root, payloads)
