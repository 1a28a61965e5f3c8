"""WARC records in ZIP packages, written and read by range.

Each task writes one package: a ZIP archive whose members are stored, `archive/data.warc.gz` with one gzip member per
record, and `indexes/index.cdxj` with a line per record. The reader parses the end record, the ZIP64 records and the
central directory, finds a stored member's bytes behind its local header, and range-reads the index and then single
records; nothing is extracted. Packages lie in the shared folder and are reached through pyarrow's file systems, so any
folder that it can open will do. A task writes under a name of its own attempt and renames at the end, so a repeated
task replaces its package.

Records with equal payloads of at least `MIN_REVISIT` bytes: those of the smallest id are responses, others revisit it.
Rows that repeat that id with that payload are all responses. Null ids count as larger than any; a payload that only
they have is a response each time. Null and empty pages have an empty payload. An empty table gives packages without
records, or none, and no rows. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import cut, shared_dir, table

MIN_REVISIT = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", uri if re.match(r"^[a-z][a-z0-9+.-]*:", uri) else f"file://{uri}")
    return pafs.FileSystem.from_uri(uri)


# --- records ------------------------------------------------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, with the payload's length, and not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target} {digest}')}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if target else []),
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """What a record says of itself; a response's payload is checked against its digest and length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    page = fields.get("X-Page-Id")
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
    return {"page_id": None if page is None else int(page), "url": fields.get("WARC-Target-URI"), "type": kind, "payload": payload if kind == "response" else None, "size": size, "digest": digest, "refers_to": int(refers.group(1)) if refers else None}


# --- ZIP directory ------------------------------------------------------------------------------------------------------


class Package:
    """A ZIP archive read by ranges of `read(offset, length)`."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = self._directory()

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """Name to (method, stored size, local header's offset)."""
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        total, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        locator = tail_at + at - 20
        if locator >= 0 and (raw := self.read(locator, 20))[:4] == b"PK\x06\x07":
            (end64,) = struct.unpack("<Q", raw[8:16])
            record64 = self.read(end64, 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator says")
            total, length, start = struct.unpack("<QQQ", record64[32:56])
        raw, out, at = self.read(start, length), {}, 0
        for _ in range(total):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method = struct.unpack("<H", raw[at + 10 : at + 12])[0]
            packed, plain, name_len, extra_len, note_len = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
            (offset,) = struct.unpack("<I", raw[at + 42 : at + 46])
            name = raw[at + 46 : at + 46 + name_len].decode()
            extra = raw[at + 46 + name_len : at + 46 + name_len + extra_len]
            while len(extra) >= 4:
                tag, n = struct.unpack("<HH", extra[:4])
                if tag == 1:  # ZIP64: the fields that the short ones leave to it, in this order
                    values = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    if plain == 0xFFFFFFFF:
                        plain = values.pop(0)
                    if packed == 0xFFFFFFFF:
                        packed = values.pop(0)
                    if offset == 0xFFFFFFFF:
                        offset = values.pop(0)
                extra = extra[4 + n :]
            out[name] = (method, packed, offset)
            at += 46 + name_len + extra_len + note_len
        return out

    def stored(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        method, packed, offset = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.read(offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no local header where the directory says")
        name_len, extra_len = struct.unpack("<HH", head[26:30])
        return offset + 30 + name_len + extra_len, packed


# --- distributed --------------------------------------------------------------------------------------------------------


class _Forward:
    """A stream that zipfile treats as one it can't seek in."""

    def __init__(self, out):
        self.out = out

    def write(self, data):
        self.out.write(data)
        return len(data)

    def flush(self):
        pass


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, digest, first): first is the least id among equal payloads that are revisited, else null."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    small = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(html.cast("binary"), 256).alias("d"), F.octet_length(html).alias("n")).where(F.col("n") >= MIN_REVISIT)
    twice = small.groupBy("d").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "first")
    twice = cut(twice)
    limit = int(re.sub(r"\D", "", pages.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")) or 0)
    unit = 1024 if pages.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").lower().rstrip("b").endswith("k") else 1
    if twice.count() * 128 <= min(limit * unit, 32 << 20):  # the table of repeated payloads is small: pages stay where they are
        twice = F.broadcast(twice)
    return rows.join(twice, rows.digest == twice.d, "left").drop("d")


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a package per task under `folder`; (path, records) of each. rows: those of `marked`."""

    def run(frames):
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():06d}.wacz"
        mine = f"{name}.{context.taskAttemptId()}"
        index: list[str] = []
        with system.open_output_stream(mine) as raw, zipfile.ZipFile(_Forward(raw), "w", zipfile.ZIP_STORED) as z:
            at = 0
            with z.open(DATA, "w", force_zip64=True) as out:
                for b in frames:
                    for i in range(0, b.num_rows, 256):
                        part = b.slice(i, 256)
                        for page, url, payload, digest, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                            revisit = first is not None and page != first
                            data = gzip.compress(record(page, url, payload, digest, first, revisit), 1, mtime=0)
                            out.write(data)
                            index.append(json.dumps({"id": page, "offset": at, "length": len(data), "digest": digest}))
                            at += len(data)
            with z.open(INDEX, "w", force_zip64=True) as out:
                for k in range(0, len(index), 4096):
                    out.write(("\n".join(index[k : k + 4096]) + "\n").encode())
        system.move(mine, name)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name.rsplit('/', 1)[1]}"]), pa.array([len(index)], pa.int64())], names=["path", "records"])

    return rows.select("id", "url", "payload", "digest", "first").mapInArrow(run, "path string, records long")


def _ranges(path: str):
    system, inner = opened(path)
    f = system.open_input_file(inner)

    def read(offset: int, length: int) -> bytes:
        f.seek(offset)
        return f.read(length)

    return f, read


def entries(paths: DataFrame, part: int = 1 << 20) -> DataFrame:
    """(path, offset, length) of every record of the packages in column `path`, from their indexes read in parts."""

    def run(frames):
        for b in frames:
            for path in b.column(0).to_pylist():
                f, read = _ranges(path)
                with f:
                    package = Package(read, f.size())
                    base, _ = package.stored(DATA)
                    at, left = package.stored(INDEX)
                    rest = b""
                    while left:
                        got = read(at, min(part, left))
                        at, left = at + len(got), left - len(got)
                        *lines, rest = (rest + got).split(b"\n")
                        said = [json.loads(x) for x in lines]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(said), pa.string()), pa.array([base + x["offset"] for x in said], pa.int64()), pa.array([x["length"] for x in said], pa.int64())], names=["path", "offset", "length"])

    return paths.select("path").mapInArrow(run, "path string, offset long, length long")


def read(listed: DataFrame, payloads: bool = False) -> DataFrame:
    """The records at (path, offset, length), range-read one by one; payload is null unless asked for, and in revisits."""
    spread = listed.repartition(F.col("path"), F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("path", "offset")
    names = ["page_id", "url", "type", "size", "digest", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(frames):
        now, f, get = None, None, None
        for b in frames:
            for i in range(0, b.num_rows, 256):
                rows = []
                for path, offset, length in zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True):
                    if path != now:
                        if f is not None:
                            f.close()
                        f, get = _ranges(path)
                        now = path
                    rows.append(parsed(zlib.decompress(get(offset, length), 31)))
                cols = [pa.array([r[n] if n != "payload" or payloads else None for r in rows], t) for n, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        if f is not None:
            f.close()

    return spread.mapInArrow(run, "page_id long, url string, type string, size long, digest string, refers_to long, payload binary")


def archive(pages: DataFrame, folder: str, **cols) -> DataFrame:
    """Writes the pages' packages; (path, records). The files are the result: they stay until the caller removes them."""
    return cut(write(marked(pages, **cols), folder))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"


def op6_warc(spark, sf_dir):
    found = read(entries(archive(table(spark, sf_dir, "pages"), new_folder(spark))))
    return found.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""
