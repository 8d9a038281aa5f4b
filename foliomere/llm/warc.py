"""WARC records in ZIP packages: written by tasks, read back by ranges.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (one
gzip member a record) and ``indexes/index.idx`` (one line a record: offset, length, record id).
Sizes and offsets past 32 bits go to ZIP64 fields. The reader parses the end records, ZIP64
ones included, and the central directory, finds the stored members, reads the index by range
and deals blocks of it to tasks, which read their records by range. Nothing is extracted.

Edge cases: a null html is an empty payload; a null url leaves out the target; rows with a null
page_id are written and come back null, and are the response only if no id of their group is
set; of repeated rows with the largest id each is a response; an empty table writes no package
and reads as no rows; other columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stage_table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.idx"
#: Records that a reading task is given at a time.
BLOCK = 2000
_MISSING = -(2**63)
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

#: Fixed values of the ZIP format: signatures and fields of its records.
_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END64, _LOCATOR = b"PK\x06\x06", b"PK\x06\x07"
_LOCAL_F = struct.Struct("<4s5H3I2H")
_CENTRAL_F = struct.Struct("<4s6H3I5H2I")
_END_F = struct.Struct("<4s4H2IH")
_END64_F = struct.Struct("<4sQ2H2I4Q")
_LOCATOR_F = struct.Struct("<4sIQI")
_MAX = 0xFFFFFFFF


class Package:
    """Writes stored members one after another, sizes in ZIP64 fields throughout."""

    def __init__(self, sink):
        self.sink, self.at, self.members = sink, 0, []

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc = name.encode(), self.at, 0
        # bit 3: checksum and sizes follow the data
        self.put(_LOCAL_F.pack(_LOCAL, 45, 8, 0, 0, 33, 0, _MAX, _MAX, len(self.name), 20) + self.name + struct.pack("<2H2Q", 1, 16, 0, 0))
        self.first = self.at

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.put(data)

    def end(self) -> None:
        size = self.at - self.first
        self.put(struct.pack("<4sI2Q", b"PK\x07\x08", self.crc, size, size))
        self.members.append((self.name, self.start, size, self.crc))

    def close(self) -> None:
        start = self.at
        for name, at, size, crc in self.members:
            extra = struct.pack("<2H3Q", 1, 24, size, size, at)
            self.put(_CENTRAL_F.pack(_CENTRAL, 45, 45, 8, 0, 0, 33, crc, _MAX, _MAX, len(name), len(extra), 0, 0, 0, 0, _MAX) + name + extra)
        n, size, end = len(self.members), self.at - start, self.at
        self.put(_END64_F.pack(_END64, 44, 45, 45, 0, 0, n, n, size, start))
        self.put(_LOCATOR_F.pack(_LOCATOR, 0, end, 1))
        self.put(_END_F.pack(_END, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, _MAX), _MAX, 0))


def read_range(source, at: int, size: int) -> bytes:
    source.seek(at)
    return source.read(size)


def directory(source) -> dict[str, tuple[int, int]]:
    """First byte and size of each stored member's data, from the central directory."""
    size = source.size()
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = read_range(source, tail_at, size - tail_at)
    # a comment may hold the signature too: the record's comment must end where the file does
    ends = [at for at in (m.start() for m in re.finditer(re.escape(_END), tail)) if at + _END_F.size <= len(tail) and at + _END_F.size + _END_F.unpack_from(tail, at)[-1] == len(tail)]
    if not ends:
        raise ValueError("not a ZIP file")
    at = ends[-1]
    _, _, _, _, n, length, start, _ = _END_F.unpack_from(tail, at)
    if n == 0xFFFF or length == _MAX or start == _MAX:
        _, _, at64, _ = _LOCATOR_F.unpack(read_range(source, tail_at + at - _LOCATOR_F.size, _LOCATOR_F.size))
        *_, n, length, start = _END64_F.unpack(read_range(source, at64, _END64_F.size))
    data, at, out = read_range(source, start, length), 0, {}
    for _ in range(n):
        f = _CENTRAL_F.unpack_from(data, at)
        packed, full, first = f[8], f[9], f[16]
        at += _CENTRAL_F.size
        name, extra = data[at : at + f[10]].decode(), data[at + f[10] : at + f[10] + f[11]]
        at += f[10] + f[11] + f[12]
        while len(extra) >= 4:  # wide values stand in the ZIP64 field, those that overflow, in this order
            kind, long = struct.unpack_from("<2H", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{long // 8}Q", extra, 4))
                full, packed, first = (next(wide) if v == _MAX else v for v in (full, packed, first))
            extra = extra[4 + long :]
        if f[4] == 0:  # stored
            head = _LOCAL_F.unpack(read_range(source, first, _LOCAL_F.size))
            out[name] = (first + _LOCAL_F.size + head[9] + head[10], full)
    return out


def record(page: int, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, as a gzip member."""
    name = lambda x: f"<urn:page:{'none' if x == _MISSING else x}>"
    revisit = refers_to is not None
    body = _HTTP.format(len(html)).encode() + (b"" if revisit else html)
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page)}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "WARC-Date: 2000-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> dict[str, object]:
    """Fields and payload of one record's bytes."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return {"fields": fields, "http": http.decode(), "payload": payload}


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """One package a task; returns one row a package. Equal payloads are stored once.

    Groups are found on (SHA-1, length) alone: counts are summed before the exchange, and only
    digests that occur twice or more are joined back."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("sha", F.sha1("html"))
    same = rows.groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").select("sha", "top")
    rows = rows.join(same, "sha", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        task, out, index = TaskContext.get(), None, []
        for b in batches:
            if not len(b):
                continue
            if out is None:
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                path = f"{root}/part-{task.partitionId():06d}.wacz"
                draft = f"{path}.{task.taskAttemptId()}"
                sink = store.open_output_stream(draft)
                out = Package(sink)
                out.begin(ARCHIVE)
            for page, url, html, sha, top in zip(b["page_id"], b["url"], b["html"], b["sha"], b["top"], strict=True):
                page = _MISSING if pd.isna(page) else int(page)
                first = pd.isna(top) or page == int(top)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = record(page, url, html, digest, None if first else int(top))
                index.append(f"{out.at - out.first} {len(data)} {page}\n")
                out.write(data)
        if out is not None:
            out.end()
            out.begin(INDEX)
            for k in range(0, len(index), 10_000):
                out.write("".join(index[k : k + 10_000]).encode())
            out.end()
            out.close()
            sink.close()
            store.move(draft, path)
            yield pd.DataFrame({"path": [path], "n": [len(index)]})

    columns = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "sha", F.col("top").cast("string").alias("top"))
    return stage_table(columns.mapInPandas(write, "path string, n long"), "warc-packages")


def read_packages(packages: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Rows of all records: page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload)."""
    spread = max(1, packages.count())

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for path in b["path"]:
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as source:
                    parts = directory(source)
                    data_at, _ = parts[ARCHIVE]
                    index_at, index_size = parts[INDEX]
                    left, done = b"", 0
                    places: list[tuple[int, int]] = []
                    while done < index_size or left:
                        more = read_range(source, index_at + done, min(1 << 20, index_size - done))
                        done += len(more)
                        *lines, left = (left + more).split(b"\n")
                        places += [tuple(map(int, x.split()[:2])) for x in lines]
                        while len(places) >= BLOCK or (places and done >= index_size):
                            own, places = places[:BLOCK], places[BLOCK:]
                            yield pd.DataFrame({"path": [path], "at": [data_at + own[0][0]], "sizes": [[n for _, n in own]]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        page = lambda x: None if x is None or x == "<urn:page:none>" else int(x[10:-1])
        for b in batches:
            for path, at, sizes in zip(b["path"], b["at"], b["sizes"], strict=True):
                store, _ = fs.FileSystem.from_uri(folder)
                out = []
                with store.open_input_file(path) as source:
                    for n in sizes:
                        r = parse(read_range(source, at, int(n)))
                        at += int(n)
                        f, payload = r["fields"], r["payload"]
                        size = int(r["http"].rpartition("Content-Length: ")[2])
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if f["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"damaged record at {at} in {path}")
                        out.append([page(f["WARC-Record-ID"]), size, digest, f["WARC-Type"], page(f.get("WARC-Refers-To")), f.get("WARC-Target-URI")] + [payload] * with_payload)
                yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * with_payload
    blocks = packages.repartition(spread, "path").mapInPandas(locate, "path string, at long, sizes array<long>")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    return blocks.repartition(spread, "path", "at").mapInPandas(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read all records."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder), folder)
